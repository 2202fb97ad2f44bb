"""Vectors of symbols: a deterministic hashing embedder, kept up to date by text hash, and search that fuses both tiers.

No trained model is available offline. The embedder is pluggable: whatever gives an array of floats for a text takes
the place of vectors(); its name is part of each text's hash, so another model replaces every vector.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from orbweft.functions import text as fn
from orbweft.operators import retrieval, search

MODEL, DIM = "hashing-v1", 384
#: Kinds that are embedded.
KINDS = ("class", "interface", "struct", "trait", "enum", "function", "method", "constructor", "route", "module", "section", "type_alias")


def vector(text: str, dim: int = DIM) -> np.ndarray:
    """A text's words, and the trigrams of each at half the weight, hashed to signed places; of length 1 or 0."""
    out = np.zeros(dim)
    for word in re.findall(r"[^\W_]+", text.lower()):
        framed = f"<{word}>"
        for part, weight in [(word, 1.0), *((framed[i : i + 3], 0.5) for i in range(len(framed) - 2))]:
            h = zlib.crc32(part.encode())
            out[(h >> 1) % dim] += weight if h & 1 else -weight
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def vectors(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: vector(t or ""))


@F.pandas_udf(BinaryType())
def encoded(vecs: pd.Series) -> pd.Series:
    """Little-endian floats of 4 bytes."""
    return vecs.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decoded(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def normalised(vec: Column) -> Column:
    """A vector of length 1; one without length stays."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vec, lambda x: (x / norm).cast("float"))).otherwise(vec)


def texts(symbols: DataFrame, model: str = MODEL) -> DataFrame:
    """id, file, text, text_hash of the symbols that are embedded."""
    up = symbols.select(F.col("id").alias("__up"), F.col("fqn").alias("__up_fqn"))
    x = symbols.where(F.col("kind").isin(*KINDS)).join(up, symbols.parent == F.col("__up"), "left")
    text = fn.symbol_text(*[F.col(c) for c in ("kind", "name", "fqn", "file", "signature", "doc", "__up_fqn")])
    return x.select("id", "file", text.alias("text")).withColumn("text_hash", fn.text_hash(F.lit(model), F.col("text")))


def pending(symbols: DataFrame, known: DataFrame, model: str = MODEL) -> DataFrame:
    """id, file, text, text_hash of what has no vector (id, text_hash) of its present text by this model."""
    return texts(symbols, model).join(known.select("id", "text_hash"), ["id", "text_hash"], "left_anti")


def refreshed(symbols: DataFrame, known: DataFrame, model: str = MODEL) -> DataFrame:
    """id, file, text_hash, vec of all symbols: known vectors that still hold, and new ones; those of others are gone."""
    now = texts(symbols, model)
    same = known.join(now.select("id", "text_hash"), ["id", "text_hash"], "left_semi").select("id", "file", "text_hash", "vec")
    return same.union(pending(symbols, known, model).select("id", "file", "text_hash", vectors("text").alias("vec")))


def semantic_search(vecs: DataFrame, question: str, *, k: int = 40, floor: float = 0.2) -> DataFrame:
    """id, score, rank of the k symbols whose vectors are most like the question's; ties by id."""
    hits = retrieval.cosine_topk(vecs, vector(question).tolist(), k, floor=floor)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def hybrid(symbols: DataFrame, metrics: DataFrame, vecs: DataFrame, question: str, *, limit: int = 20, **options) -> DataFrame:
    """id, score by search and vectors together; by search alone where there is no vector."""
    near = None if vecs.isEmpty() else semantic_search(vecs, question, k=max(20, 2 * limit)).select("id", "rank")
    return search.search(symbols, metrics, question, limit=limit, semantic=near, **options)
