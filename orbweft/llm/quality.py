"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed trigrams of its letters, of the shapes of its characters (small, capital, digit, space, other
signs as they are) and marks of words that repeat the one before. A truncated singular value decomposition of the
labelled sample's weighted terms gives the latent space. The labelled vectors are broadcast (their number is bounded);
every text's vector is multiplied with all of them, block by block, and its most similar neighbours vote with their
similarities.

Training takes a bounded sample: up to BAD texts of label 0 and GOOD of label 1, by a hash of doc_id, of those labels
that may be learned from; votes are weighted back to the shares the labels have.

Defined results: null and empty texts have no terms; they and texts without a positive neighbour get the share of
label 1 among the labels; without any label to learn from the score is 0.5; a null doc_id is not held out and not
learned from; a doc_id that has several labels or texts is learned with the least of each; of equally similar
neighbours those of the least doc_ids vote; repeated rows are scored alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweft.llm.arrays import flat, runs
from orbweft.llm.language import folded, held_out, sliced
from orbweft.session import table

BAD, GOOD = 800, 1400
LETTERS, SHAPES = 1024, 1024
TERMS = LETTERS + SHAPES + 1
RANK, NEIGHBOURS, SLICE, BLOCK = 48, 25, 1 << 20, 512
THRESHOLD = 0.7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[[9, 11, 12, 13]] = 97, 65, 48, 32
_SHAPE[128:] = 97


def _hashed(x: np.ndarray, bits: int) -> np.ndarray:
    x = x.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of times each text has each term."""
    n, size = len(off) - 1, len(data)
    if n == 1 and size > SLICE:
        return long_counts(data, SLICE)[None]
    out = np.zeros(n * TERMS)
    if size < 3:
        return out.reshape(n, TERMS)
    base = np.repeat(np.arange(n, dtype=np.int64) * TERMS, np.diff(off))
    inside = np.ones(size - 2, bool)
    for k in (1, 2):
        edge = off[1:] - k
        edge = edge[(edge >= off[:-1]) & (edge < size - 2)]
        inside[edge] = False
    base = base[:-2][inside]
    out += np.bincount(base + _hashed(folded(data), 10)[inside], minlength=len(out))
    out += np.bincount(base + LETTERS + _hashed(_SHAPE[data], 10)[inside], minlength=len(out))
    out = out.reshape(n, TERMS)
    # Words that repeat the one before, by weighted sums of their bytes.
    space = (data == 32) | (data == 10)
    start = ~space
    start[1:] &= space[:-1]
    start[off[:-1][off[1:] > off[:-1]]] |= ~space[off[:-1][off[1:] > off[:-1]]]
    a = np.flatnonzero(start)
    if len(a) > 1:
        place = np.arange(size) - np.concatenate([np.zeros(a[0], np.int64), np.repeat(a, np.diff([*a, size]))]) + 7
        sums = np.add.reduceat(np.where(space, 0, (data.astype(np.int64) + 1) * place), a)
        doc = np.searchsorted(off, a, "right") - 1
        same = (sums[1:] == sums[:-1]) & (doc[1:] == doc[:-1])
        out[:, -1] += np.bincount(doc[1:][same], minlength=n) * 3.0
    return out


def long_counts(data: np.ndarray, step: int) -> np.ndarray:
    """counts() of one text of three bytes or more, taken in step bytes at a time."""
    out = np.zeros(TERMS)
    for low, high, at, n in sliced(len(data), step):
        part = data[low:high]
        for first, x in ((0, folded(part)), (LETTERS, _SHAPE[part])):
            if len(x) > 2:
                out[first : first + 1024] += np.bincount(_hashed(x, 10)[at : at + n], minlength=1024)
    out[-1] = 3.0 * repeats(data, step)
    return out


def repeats(data: np.ndarray, step: int) -> int:
    """Number of words that repeat the one before, by weighted sums of their bytes; a word may go on over many steps."""
    found, before, part, size = 0, None, 0, 0
    for i in range(0, len(data), step):
        d = data[i : i + step].astype(np.int64) + 1
        space = (d == 33) | (d == 11)
        if size:  # a word is open
            end = int(space.argmax()) if space.any() else len(d)
            part += int((d[:end] * (np.arange(end) + size + 7)).sum())
            size += end
            if end == len(d):
                continue
            found += part == before
            before, size = part, 0
            d, space = d[end:], space[end:]
        start = ~space
        start[1:] &= space[:-1]
        a = np.flatnonzero(start)
        if not len(a):
            continue
        place = np.arange(len(d)) - np.concatenate([np.zeros(a[0], np.int64), np.repeat(a, np.diff([*a, len(d)]))]) + 7
        sums = np.add.reduceat(np.where(space, 0, d * place), a)
        if not space[-1]:
            part, size, sums = int(sums[-1]), len(d) - int(a[-1]), sums[:-1]
        if len(sums):
            found += int((sums[1:] == sums[:-1]).sum()) + (before is not None and int(sums[0]) == before)
            before = int(sums[-1])
    return found + bool(size and part == before)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of shares within letters, shapes and marks, times the weights; length 1."""
    total = c[:, :LETTERS].sum(1, keepdims=True)
    x = (c / np.maximum(total, 1)).astype(np.float32, copy=False)
    np.sqrt(x, out=x)
    x *= idf.astype(np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)
    return x


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row; of equal ones at the end the first."""
    pick = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, pick, 1).min(1, keepdims=True)
    for i in np.flatnonzero((near >= least).sum(1) > k):
        pick[i] = np.argsort(-near[i], kind="stable")[:k]
    return pick


def leading(gram: np.ndarray, rank: int, more: int = 80, steps: int = 200) -> np.ndarray:
    """The rank leading eigenvectors of a symmetric matrix without negative eigenvalues, by orthogonal iteration on some
    more of them until they stay where they are; nothing as large as the matrix is made besides it."""
    n = len(gram)
    axes = np.linalg.qr(np.random.default_rng(0).standard_normal((n, min(n, rank + more))).astype(gram.dtype))[0]
    for k in range(steps):
        ahead = gram @ axes
        if k % 10 == 9:
            values, turn = np.linalg.eigh(axes.T @ ahead)
            turn = turn[:, ::-1][:, :rank]
            apart = np.linalg.norm(ahead @ turn - axes @ turn * values[::-1][:rank])
            if apart <= 1e-5 * max(values[-1], 1e-30):
                return axes @ turn
        axes = np.linalg.qr(ahead)[0]
    turn = np.linalg.eigh(axes.T @ (gram @ axes))[1]
    return axes @ turn[:, ::-1][:, :rank]


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    @classmethod
    def fit(cls, c: np.ndarray, labels: np.ndarray, shares: dict[int, int]) -> Model:
        n = len(c)
        if not n:
            return cls(np.ones(TERMS), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, labels, 0.5)
        idf = np.log((1 + n) / (1 + (c > 0).sum(0))) + 0.2
        idf[LETTERS:] *= 2.0
        x = weighted(c, idf)
        axes = leading(x.T @ x, RANK)
        v = x @ axes
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        own = np.array([max(1, (labels == k).sum()) for k in (0, 1)], float)
        weight = np.array([shares.get(k, 0) for k in (0, 1)]) / own
        return cls(idf, axes, v, labels.astype(float), weight[labels], shares.get(1, 0) / max(1, sum(shares.values())))

    def score(self, c: np.ndarray) -> np.ndarray:
        out = np.full(len(c), self.prior)
        k = min(NEIGHBOURS, len(self.vectors))
        if not k:
            return out
        q = weighted(c, self.idf) @ self.axes
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        for i in range(0, len(q), BLOCK):
            near = q[i : i + BLOCK] @ self.vectors.T
            pick = nearest(near, k)
            alike = np.take_along_axis(near, pick, 1).astype(float)
            vote = np.where(alike > 0, alike, 0) ** 8 * self.weights[pick]
            total = vote.sum(1)
            good = (vote * self.labels[pick]).sum(1)
            out[i : i + BLOCK] = np.where(total > 0, good / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def text_counts(column: pa.Array):
    data, off = flat(column)
    for i, j in runs(off, SLICE):
        for a in range(i, j, BLOCK):
            b = min(a + BLOCK, j)
            yield counts(data[off[a] : off[b]], off[a : b + 1] - off[a])


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """docs: doc_id and text; labels: doc_id and quality."""
    known = labels.where(allowed & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {int(r[0]): r[1] for r in known.groupBy("quality").count().collect()}
    picked = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((0, BAD), (1, GOOD))]
    ids = picked[0].union(picked[1]).select(F.col("doc_id").alias("__id"), "quality")  # BAD + GOOD rows at most
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).where("text IS NOT NULL").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            for x, y, z in zip(b.column(0), b.column(1), (r for c in text_counts(b.column(2)) for r in c), strict=True):
                yield pa.RecordBatch.from_pydict({"doc_id": [x.as_py()], "quality": [y.as_py()], "c": [zlib.compress(z.astype(np.float32), 1)]}, schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("c", pa.binary())]))

    got = rows.withColumn("quality", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, c binary").collect()
    got.sort(key=lambda r: r.doc_id)
    c = np.empty((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        c[i] = np.frombuffer(zlib.decompress(r.c), np.float32)
    return Model.fit(c, np.array([r.quality for r in got], int), shares)


def scores(docs: DataFrame, model: Model, keep: list[str], score: str = "score") -> DataFrame:
    """The columns keep of docs with the score of text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    width, names = len(keep), [*keep, score]
    schema = ready.select(*keep, F.lit(0.0).alias(score)).schema

    def run(batches):
        for b in batches:
            value = [sent.value.score(c) for c in text_counts(b.column(width))]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(np.concatenate(value) if value else np.zeros(0))], names)

    return ready.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = train(rows, known, ~held_out(F.col("doc_id"), 4, 2))
    out = scores(rows.withColumn("held_out", held_out(F.col("doc_id"), 4, 2)), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_quality_neighbours(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to have label 1, with their columns; all where there is no label."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = train(rows, known, F.lit(True))
    if not len(model.vectors):
        return docs
    return scores(rows, model, ["row"]).where(F.col("score") >= THRESHOLD).select("row.*")
