"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a set of texts that no longer changes; it can be saved and loaded, and a batch can meet several. Its
digests are dealt into buckets by a hash, and each bucket carries a three-wise binary-fuse filter, which answers for a
digest with one byte compare and is wrong for one in 256 that the bucket lacks. An incoming batch is first grouped on its own, so copies within it cost one row however
many they are; its digests then meet the filter of their bucket, and only those that pass are joined with the exact
bucket. Of each group that either step finds, the bytes of the members are compared, not only their digests.

Texts are equal when they are identical after lower-casing A-Z. Defined results: a null text is the empty text; of equal
texts the row with the largest doc_id stays, null being smaller than any; rows that repeat a doc_id within a group are
all marked kept where theirs is the largest; an empty table or snapshot gives an empty result; other columns are not
read. Of rows that agree in doc_id and text, kept() keeps the first by their JSON form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweft.llm.arrays import mix
from orbweft.session import forget, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests a bucket holds on average at most; buckets there are at least.
BUCKET, LEAST = 1 << 16, 64
#: Rows of an id, a digest and two numbers that are broadcast at most; more are joined by a shuffle.
SENT = 1 << 18


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


@dataclass
class FuseFilter:
    """A three-wise binary-fuse filter of 8-bit fingerprints over 64-bit keys."""

    seed: int
    segment: int
    segments: int
    prints: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = min(1 << 18, 1 << max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, -(-round(n * factor) // segment) - 2)
        for seed in range(1, 1000):
            out = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if out._fill(keys):
                return out
        raise ValueError("no seed gives a filter")

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three cells (3, n) and the fingerprint of each key."""
        h = mix(keys.astype(np.uint64) + mix(np.array([self.seed], np.uint64)))
        span, mask = np.uint64(self.segment * self.segments), np.uint64(self.segment - 1)
        a = ((h >> np.uint64(32)) * span) >> np.uint64(32)
        b = (a + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        c = (a + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([a, b, c]).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel: cells that one key alone touches give that key its cell; cells are then set in reverse."""
        cells, prints = self.places(keys)
        alive, order = np.arange(len(keys)), []
        while len(alive):
            own = cells[:, alive]
            alone = np.bincount(own.ravel(), minlength=len(self.prints))[own] == 1
            free = alone.any(0)
            if not free.any():
                return False
            peeled = alive[free]
            order.append((peeled, own[alone.argmax(0)[free], np.flatnonzero(free)]))
            alive = alive[~free]
        for peeled, at in reversed(order):
            others = np.bitwise_xor.reduce(self.prints[cells[:, peeled]], 0) ^ self.prints[at]
            self.prints[at] = prints[peeled] ^ others
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        cells, prints = self.places(keys)
        return np.bitwise_xor.reduce(self.prints[cells], 0) == prints


@dataclass
class Snapshot:
    """entries: bucket, digest, keep_id, n of each distinct text; filters: bucket and its filter."""

    entries: DataFrame
    filters: DataFrame
    buckets: int

    def save(self, path: str) -> None:
        """Write the snapshot to a new folder for later batches."""
        self.entries.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/entries")
        self.filters.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/filters")

    @classmethod
    def load(cls, spark, path: str) -> Snapshot:
        entries, filters = (spark.read.parquet(f"{path}/{k}") for k in ("entries", "filters"))
        first = filters.select("buckets").first()
        return cls(entries.drop("buckets"), filters.drop("buckets"), first[0] if first else LEAST)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and digest of every row; texts are read and left."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"))


def grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, digest, h, keep_id, n: one row a digest, combined before the shuffle."""
    one = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    h = F.xxhash64("digest")
    return one.select(F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), "digest", h.alias("h"), "keep_id", "n")


def buckets_for(rows: int) -> int:
    return max(LEAST, -(-rows // BUCKET))


def snapshot(rows: DataFrame, buckets: int) -> Snapshot:
    """Freeze keyed rows: exact buckets, and a filter for each."""
    entries = stored(grouped(rows, buckets), "snapshot")

    def build(key, frame):
        f = FuseFilter.build(frame.column("h").to_numpy().astype(np.uint64))
        return pa.Table.from_pydict({"bucket": pa.array([key[0].as_py()], pa.int32()), "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "prints": pa.array([f.prints.tobytes()], pa.binary())})

    filters = entries.select("bucket", "h").groupBy("bucket").applyInArrow(build, "bucket int, seed long, segment long, segments long, prints binary")
    return Snapshot(entries, stored(filters, "filters"), buckets)


def screened(batch: DataFrame, snap: Snapshot) -> DataFrame:
    """Those digests of a grouped batch that the snapshot's filters let pass."""

    def screen(frame, filters):
        if not filters.num_rows or not frame.num_rows:
            return frame.slice(0, 0)
        x = filters.slice(0, 1).to_pylist()[0]
        f = FuseFilter(x["seed"], x["segment"], x["segments"], np.frombuffer(x["prints"], np.uint8))
        return frame.filter(pa.array(f.holds(frame.column("h").to_numpy().astype(np.uint64))))

    return batch.groupBy("bucket").cogroup(snap.filters.groupBy("bucket")).applyInArrow(screen, batch.schema)


def against(batch: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """digest, keep_id, n of every digest of a grouped batch, together with what any of the snapshots has of it."""
    own = batch.select("digest", "keep_id", "n")
    for snap in snapshots:
        dealt = batch.withColumn("bucket", F.pmod("h", F.lit(snap.buckets)).cast("int"))
        hits = screened(dealt, snap).select("digest")
        own = own.union(snap.entries.join(hits, "digest", "left_semi").select("digest", "keep_id", "n"))
    return own.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def merged(batch: DataFrame, snap: Snapshot) -> DataFrame:
    """digest, keep_id, n of every group of the batch and the snapshot together."""
    hits = stored(screened(batch, snap), "hits").select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    old = snap.entries.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
    both = old.join(hits, "digest").select("digest", F.greatest("old_id", "new_id").alias("keep_id"), (F.col("old_n") + F.col("new_n")).alias("n"))
    matched = both.select("digest")
    rest = [x.select("digest", "keep_id", "n").join(matched, "digest", "left_anti") for x in (snap.entries, batch)]
    return both.union(rest[0]).union(rest[1])


def sent(written: DataFrame, limit: int = SENT) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has no more rows than limit."""
    return F.broadcast(written) if written.count() <= limit else written


def byte_checked(docs: DataFrame, several: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest, keep_id, n of the groups of several texts (digest), by their bytes.

    Rows whose digests agree are grouped once more by the text itself, so equal digests of unequal texts part here.
    Copies are combined before the shuffle, so a group of any size sends one text from each task.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    copies = rows.join(several.select("digest"), "digest", "left_semi")
    return copies.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).select("digest", "keep_id", "n")


def deduplicated(docs: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = SENT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; incoming says which rows are the new batch."""
    rows = stored(keyed(docs, id_col, text_col).withColumn("new", F.coalesce(incoming, F.lit(False))), "keys")
    buckets = buckets_for(rows.count())
    snap = snapshot(rows.where("NOT new").drop("new"), buckets)
    batch = stored(grouped(rows.where("new").drop("new"), buckets), "batch")
    several = stored(merged(batch, snap).where("n > 1").select("digest"), "several")
    forget(batch, snap.entries, snap.filters)
    checked = stored(byte_checked(docs, sent(several, limit), id_col, text_col), "checked")
    unequal = checked.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    if not unequal.isEmpty():
        raise ValueError("two unequal texts have one SHA-256 digest")
    out = rows.join(sent(checked, limit), "digest", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def later_half(doc_id: Column) -> Column:
    """The incoming batch of a table that has no batches of its own: every other document, by a hash of doc_id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)) == 1


def op2_fuse_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: half of them a snapshot, the other half a batch that comes in."""
    return deduplicated(table(spark, sf_dir, "documents"), later_half(F.col("doc_id")))


def kept(docs: DataFrame, limit: int = SENT) -> DataFrame:
    """One row of docs for each text, with its columns: that with the largest doc_id, the first by JSON if several have it.

    Only the keys of rows that go, or that stand for several alike, are joined back.
    """
    keys = deduplicated(docs, later_half(F.col("doc_id")), limit=limit).where("group_size > 1").groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("n"))
    keys = stored(keys.where("NOT kept OR n > 1"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("sha"))
    match = lambda k: rows.id.eqNullSafe(k.doc_id) & (rows.sha == k.text_sha256)
    gone, again = sent(keys, limit), sent(keys.where("kept"), limit)
    alike = rows.join(again, match(again), "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(gone, match(gone), "left_anti").select("row.*").union(alike.select("row.*"))


OP2_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
