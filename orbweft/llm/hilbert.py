"""Sharding in Hilbert-curve order.

Several metadata dimensions are quantised, each row gets its index on the Hilbert curve through that grid, rows are
sorted by the index and the order is cut into runs. Cells keep the order of their values and each holds about as many
rows: a value's cell is its place among the dimension's quantiles, of which there are CUTS whatever the table's size.
Rows of a shard are then close in every dimension at once, and a reader with a filter on any of them skips shards by
their minima and maxima.

Law of the query: ``rows`` (counts at most one apart). Ranks are exact and need no single task: a range partitioning
sorts the rows, each partition's count is summed into an offset, and rank = offset + place in the partition.

Defined results: null text has no bytes, so its size is 1; null metadata go to the first cell; rows with equal metadata
follow by doc_id, null first; repeated rows each get a slot; an empty table gives an empty result; other columns are
not read, but for write(), which keeps them.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweft.session import stored, table

#: Bits of each dimension; 4 dimensions of 10 bits make an index of 40 bits.
BITS = 10
#: Quantiles of a dimension, and the accuracy with which they are taken.
CUTS, ACCURACY = 255, 10_000


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of cells (n, d), by the transposed form of the curve."""
    x = cells.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(d):
            up = (x[i] & q) != 0
            t = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            if i:
                x[i] ^= t
        q >>= one
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = one << np.uint64(bits - 1)
    while q > one:
        t ^= np.where((x[d - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def text_key(value: Column) -> Column:
    """A number that keeps the order of texts by their first seven bytes."""
    raw = F.rpad(F.substring(F.encode(value, "UTF-8"), 1, 7), 7, F.lit(b"\0"))
    return F.conv(F.hex(raw), 16, 10).cast("long")


def quantiles(df: DataFrame, keys: list[Column]) -> list[np.ndarray]:
    """Of each key CUTS quantiles, in order; common values take several."""
    at = [(i + 0.5) / CUTS for i in range(CUTS)]
    row = df.agg(*[F.percentile_approx(k, at, ACCURACY).alias(f"q{i}") for i, k in enumerate(keys)]).first()
    return [np.array(q or [], np.int64) for q in row]


def indexed(df: DataFrame, keys: list[Column], cuts: list[np.ndarray], name: str = "curve") -> DataFrame:
    """df with the Hilbert index of its keys; only the keys go to Python."""
    top = (1 << BITS) - 1

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        place = lambda c, x: np.searchsorted(c, x) + np.searchsorted(c, x, "right")
        cells = [place(c, x.to_numpy()) * top // max(1, 2 * len(c)) for c, x in zip(cuts, columns, strict=True)]
        return pd.Series(curve_index(np.stack(cells, 1)))

    lowest = F.lit(-(1 << 63))
    return df.withColumn(name, curve(*[F.coalesce(k.cast("long"), lowest) for k in keys]))


def ranked(df: DataFrame, by: list[str], rank: str = "rank") -> tuple[DataFrame, int]:
    """df with each row's place in the order of by, from 0, and the number of rows.

    The sorted partitions are written first, each row with its place, so that counts and ranks come from the same rows
    even if a task runs again.
    """
    cut = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(map(tuple, cut.groupBy(part.alias("p")).count().collect()))  # one row a partition
    total, offsets = 0, []
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "__part int, __start long")
    out = cut.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(rank, F.col("__start") + place)
    return out.drop("__part", "__start", "__at"), total


def cut_rows(df: DataFrame, total: int, shards: int, rank: str = "rank") -> DataFrame:
    """shard and slot of each rank: runs whose counts differ by at most one."""
    r, n = F.col(rank), F.lit(max(total, 1))
    shard = F.floor(((r + 1) * shards - 1) / n)
    start = F.floor(F.col("shard") * n / shards)
    return df.withColumn("shard", shard.cast("int")).withColumn("slot", (r - start).cast("long"))


DIMENSIONS = ("lang", "source", "size", "doc_id")


def _meta_columns() -> dict[str, Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {
        "doc_id": F.col("doc_id").cast("long"),
        "size": (F.octet_length(text) + 1).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")).cast("long"),
        "lang": F.col("lang").cast("string"),
        "source": F.col("source").cast("string"),
    }


def described(docs: DataFrame) -> DataFrame:
    """What is known of every document: doc_id, size, text_crc32, lang, source."""
    return docs.select(*[c.alias(n) for n, c in _meta_columns().items()])


def placed_rows(rows: DataFrame, meta: DataFrame, shards: int) -> DataFrame:
    """rows, which have meta's columns, with curve, shard and slot."""
    keys = [text_key(F.col("lang")), text_key(F.col("source")), F.col("size"), F.col("doc_id")]
    placed, total = ranked(indexed(rows, keys, quantiles(meta, keys)), ["curve", "doc_id", "text_crc32"])
    return cut_rows(placed, total, shards)


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, with lang and source kept."""
    meta = stored(described(docs), "meta")
    return placed_rows(meta, meta, shards)


def manifest(placed: DataFrame) -> DataFrame:
    """Per shard: rows, bytes and the extremes of each dimension, by which a reader prunes."""
    ends = [f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)


def wanted(about: DataFrame, **ranges: tuple) -> DataFrame:
    """shard of those that may hold rows whose dimensions lie within the ranges, by a manifest; both ends count."""
    test = [(F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high) for c, (low, high) in ranges.items()]
    return about.where(functools.reduce(Column.__and__, test, F.lit(True))).select("shard")


def write(docs: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Documents with all their columns as one folder a shard, in curve order, and the manifest beside them."""
    meta = stored(described(docs), "meta")
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in _meta_columns().items()])
    placed = placed_rows(rows, meta, shards)
    about = stored(manifest(placed), "manifest")
    about.coalesce(1).write.parquet(f"{path}/manifest")
    out = placed.select("row.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    out.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").drop("__slot").write.partitionBy("__shard").parquet(f"{path}/shards")
    return about


def op6_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by rank on the curve."""
    placed = sharded(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
