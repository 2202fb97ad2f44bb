"""Full-text and vector retrieval as DataFrame operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweft.session import stored

#: Words that say nothing in a question.
STOP = frozenset("a an the of to in on for and or is are was were be been being do does did how what where when which who whom why can could should would will shall may might must this that these those it its with without from by as at into about over under between through during before after above below up down out off again further then once here there all any both each few more most other some such no nor not only own same so than too very s t just now i me my we our you your he she they them their code function class method file module implement implemented implementation work works working use uses used using does define defined definition handle handles handled get set find show me tell explain describe list".split())
#: Suffixes taken off a query term, the first that matches and leaves four letters.
SUFFIXES = ("ings", "ing", "ed", "ers", "er", "es", "s", "ly", "tion")
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field, term, tf: the inverted index."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for f in fields])
    flat = docs.select(F.col(id_col).alias("id"), F.explode(each).alias("x")).select("id", "x.field", F.explode("x.terms").alias("term"))
    return flat.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def lengths(index: DataFrame) -> DataFrame:
    return index.groupBy("id").agg(F.sum("tf").alias("dl"))


def bm25(docs: DataFrame, id_col: str, fields: dict[str, float], phrases: list[tuple[str, bool]]) -> DataFrame:
    """id, score: the sum over phrases (term, is_prefix) of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * D / avgD)).

    f adds each field's hits times its weight; idf = ln((N - n + .5) / (n + .5)), 1e-6 at least. Only the hits of the
    phrases are kept from the tokens, so what is shuffled is as large as the answer, not the corpus. Each text is read and
    split once: its length and hits are written, and both the statistics and the scores come from there.
    """
    words = F.array(*[tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    sized = docs.select(F.col(id_col).alias("id"), words.alias("w")).select("id", "w", F.aggregate("w", F.lit(0), lambda a, x: a + F.size(x)).alias("dl"))
    hits = []
    for term, prefix in phrases:
        hit = (lambda t: t.startswith(term)) if prefix else (lambda t: t == term)  # noqa: B023
        per = [F.size(F.filter(F.col("w")[i], hit)) * float(w) for i, w in enumerate(fields.values())]
        hits.append(sum(per[1:], per[0]))
    scored = stored(sized.select("id", "dl", *[h.alias(f"f{i}") for i, h in enumerate(hits)]), "hits")
    stats = scored.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"n{i}") for i in range(len(hits))])
    x = scored.where(" OR ".join(f"f{i} > 0" for i in range(len(hits)))).crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(hits)):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        weight = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        total = total + F.when(f > 0, weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return x.select("id", total.alias("score"))


def query_terms(question: str) -> list[str]:
    """Words of a question, identifiers split, without stop words; then the stems of those that have a known suffix."""
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"[^\w$.\-\s]", " ", question))
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text)
    words = [w for w in re.sub(r"[_$.\-]+", " ", text).lower().split() if len(w) >= 2 and w not in STOP]
    out = dict.fromkeys(words)
    for w in words:
        suffix = next((s for s in SUFFIXES if w.endswith(s) and len(w) - len(s) >= 4), None)
        if suffix:
            out.setdefault(w[: -len(suffix)])
    return list(out)


def phrases(terms: list[str]) -> list[tuple[str, bool]]:
    """Each term as it is, and as a prefix if it has three letters."""
    return [p for t in terms for p in ([(t, False), (t, True)] if len(t) >= 3 else [(t, False)])]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; 0 where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    return F.when(both > 0, dot / both).otherwise(0.0)


def cosine_topk(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "id", vec_col: str = "vec", floor: float | None = None) -> DataFrame:
    """id, score of the k vectors most like query; ties by id. Top-k is taken in every task before anything moves."""
    scored = vectors.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def cosine_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = 1024) -> DataFrame:
    """query, id, score, k: the k vectors most like each query (id, vec), itself left out; ties of nine digits by id.

    Queries are a stated set. Both sides are dealt into blocks by a hash of the id, of about block vectors and four times
    as many queries; every block of vectors meets every block of queries, and two blocks are multiplied as matrices. A
    task keeps the best k so far of up to 32 blocks of queries, so what goes on grows with the tasks, not with the blocks.
    """
    import numpy as np
    import pyarrow as pa

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // size))
        dealt = df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name), F.struct("id", "vec").alias("r"))
        rows = dealt.repartition(parts, name).groupBy(name).agg(F.collect_list("r").alias("r"))  # few bytes, much work: not to be coalesced
        return rows.select(name, F.col("r.id").alias(f"ids_{name}"), F.flatten("r.vec").alias(f"vecs_{name}")), n

    (q, n), (v, _) = blocks(queries, "q", 4 * block), blocks(vectors, "v", block)
    shares = max(1, -(-4 * parts // n))  # a block of queries meets its vectors in several tasks
    copies = lambda name, to: F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias(name)
    v = v.select("*", copies("q", n)).withColumn("share", F.pmod("v", F.lit(shares))).repartition(parts, "q", "share")
    pairs = v.join(q.select("*", copies("share", shares)), ["q", "share"]).select("q", "ids_q", "vecs_q", "ids_v", "vecs_v")

    def matrix(ids, vecs) -> tuple[np.ndarray, np.ndarray]:
        names = ids.values.to_numpy(zero_copy_only=False)
        m = vecs.values.to_numpy(zero_copy_only=False).astype(float).reshape(len(names), -1)
        at = np.argsort(names, kind="stable")
        return names[at], m[at] / np.maximum(np.linalg.norm(m[at], axis=1, keepdims=True), 1e-300)

    def best(names, x, ids, y):
        """The k best of a block by digits, then id: (digits, id, score) of each query, least digits where there are fewer."""
        s = x @ y.T
        digits = np.floor(s * 1e9 + 0.5).astype(np.int64)
        digits[names[:, None] == ids[None, :]] = NONE
        key = digits * len(ids) - np.arange(len(ids))  # unique: of equal digits the least id, which comes first, is largest
        at = np.argpartition(key, len(ids) - k, axis=1)[:, -k:] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), s.shape)
        return np.take_along_axis(digits, at, 1), ids[at], np.take_along_axis(s, at, 1)

    NONE = np.int64(-(1 << 40))

    def given(kept):
        for names, (digits, ids, score) in kept.values():
            ok = digits > NONE
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ok.sum(1)), pa.int64()), pa.array(ids[ok], pa.int64()), pa.array(score[ok], pa.float64())], ["query", "id", "score"])

    def run(batches):
        kept: dict = {}
        for b in batches:
            for i, at in enumerate(b.column(0).to_pylist()):
                (names, x), (ids, y) = (matrix(b.column(c)[i], b.column(c + 1)[i]) for c in (1, 3))
                new = best(names, x, ids, y)
                if at in kept:
                    digits, near, score = (np.concatenate(z, 1) for z in zip(kept[at][1], new, strict=True))
                    first = np.lexsort((near, -digits), axis=-1)[:, :k]
                    new = tuple(np.take_along_axis(z, first, 1) for z in (digits, near, score))
                elif len(kept) == 32:
                    yield from given(kept)
                    kept = {}
                kept[at] = (names, new)
        yield from given(kept)

    got = pairs.mapInArrow(run, "query long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return got.withColumn("k", rank).where(F.col("k") <= k).select("query", "id", "score", "k")


def fuse(lexical: DataFrame, semantic: DataFrame, *, weight: float = 0.8) -> DataFrame:
    """id, score of two ranked lists (id, rank from 1) by reciprocal rank."""
    a = lexical.select("id", F.col("rank").alias("ra"))
    b = semantic.select("id", F.col("rank").alias("rb"))
    s = F.coalesce(1.0 / F.col("ra"), F.lit(0.0)) + F.coalesce(F.lit(weight) / F.col("rb"), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", (10 * s).alias("score"))


def dup_damped(hits: DataFrame, key: str, score: str = "score", *, factor: float = 0.92, most: int = 6) -> DataFrame:
    """hits with score damped by factor ** (how many of the same key rank before, most at most)."""
    before = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "id")) - 1
    return hits.withColumn(score, F.col(score) * F.pow(F.lit(factor), F.least(before, F.lit(most))))


def pack(ranked: DataFrame, budget: int, size: str = "tokens") -> DataFrame:
    """Leading rows of a ranking whose running size stays within budget; the first always fits."""
    running = F.sum(size).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", running).where((F.col("used") <= budget) | (F.col("rank") == 1))
