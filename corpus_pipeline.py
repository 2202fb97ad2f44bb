"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows to the shared folder and reads them again as the next one's documents; rows of a stage are
deleted once the next one's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweft.llm import dedup, jaccard, language, packing, quality
from orbweft.session import forget, ship, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    ship(spark)
    return language.kept(docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes call good."""
    ship(spark)
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    ship(spark)
    return dedup.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each component of near duplicates."""
    ship(spark)
    return jaccard.kept(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of bounded tokens, segments and loss-bearing tokens."""
    ship(spark)
    return packing.documents_packed(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("packing", pack),
]

#: Trained models and BPE ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
