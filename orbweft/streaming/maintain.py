"""Incremental maintenance as Structured Streaming: change batches upserted by file, and debounced flushes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from orbweft.operators.relational import upserted
from orbweft.session import delete

QUIET_MS, MOST_MS = 400, 2000


#: Parts of a maintained table, by a hash of the key; a batch writes those anew that it touches.
PARTS = 64


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def upsert_stream(changes: DataFrame, spark: SparkSession, base: str, key: str, *, parts: int = PARTS) -> DataStreamWriter:
    """A writer that replaces, batch by batch, every key of a stream of rows in the table at base.

    The table has parts by a hash of the key. Each batch writes a new version of the parts that it touches and then names
    them in a pointer table, so a batch that runs again after a failure writes the same once more and readers never see
    half of one. Versions that no reader of the last two pointers needs are deleted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        pointers = _pointers(spark, base)
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "version").alias("r")).select("r.*") if "version" in batch.columns else batch.dropDuplicates([key])
        last = last.withColumn("__part", _part(key, parts))
        touched = [r[0] for r in last.select("__part").distinct().collect()]  # parts at most
        now = _read(spark, base, {p: v for p, v in pointers.items() if p in touched and v != number})
        out = last if now is None else upserted(now.withColumn("__part", _part(key, parts)), last.select(*now.columns, "__part"), key)
        out.repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{base}/v{number}")
        if touched:
            spark.createDataFrame([(p, number) for p in touched], "part int, number long").coalesce(1).write.mode("append").parquet(f"{base}/versions")
        old = [(p, v) for p, v in pointers.items() if p in touched and v < number]
        for p, v in _before(spark, base, dict(old)):
            delete(spark, f"{base}/v{v}/__part={p}")

    return changes.writeStream.foreachBatch(apply)


def _history(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        return spark.read.schema("part int, number long").parquet(f"{base}/versions")
    except Exception as e:  # Spark has one error class for what a path lacks
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _pointers(spark: SparkSession, base: str) -> dict[int, int]:
    """The last version of each part."""
    rows = _history(spark, base)
    return {} if rows is None else {r[0]: r[1] for r in rows.groupBy("part").agg(F.max("number")).collect()}


def _before(spark: SparkSession, base: str, last: dict[int, int]) -> list[tuple[int, int]]:
    """Versions of parts that came before those given."""
    rows = _history(spark, base)
    return [] if rows is None or not last else [(r[0], r[1]) for r in rows.distinct().collect() if r[0] in last and r[1] < last[r[0]]]


def _read(spark: SparkSession, base: str, pointers: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{base}/v{v}/__part={p}" for p, v in sorted(pointers.items())]) if pointers else None


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The table's last whole version; None where nothing was written."""
    return _read(spark, base, _pointers(spark, base))


def debounced(events: DataFrame, key: str, *, quiet_ms: int = QUIET_MS, most_ms: int = MOST_MS, late: str = "10 seconds") -> DataFrame:
    """key, start_ms, end_ms, n of bursts of a stream (key, at): a burst ends quiet_ms after its last event or most_ms
    after its first. A session window cannot cap a burst, so state holds one open burst a key; the watermark's timeout
    closes what no later event does."""
    import pandas as pd

    out = f"{key} string, start_ms long, end_ms long, n long"

    def flush(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            first, last, n = state.get
            rows.append((name[0], first, last, n))
            state.remove()
        else:
            ats = sorted(int(x.timestamp() * 1000) for f in frames for x in f["at"])
            burst = list(state.get) if state.exists else None
            for t in ats:
                if burst and (t - burst[1] > quiet_ms or t - burst[0] > most_ms):
                    rows.append((name[0], *burst))
                    burst = None
                burst = [burst[0], max(t, burst[1]), burst[2] + 1] if burst else [t, t, 1]
            state.update(tuple(burst))
            state.setTimeoutTimestamp(max(min(burst[1] + quiet_ms, burst[0] + most_ms) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, "start_ms", "end_ms", "n"])

    marked = events.withWatermark("at", late).select(F.col(key).cast("string").alias(key), "at")
    return marked.groupBy(key).applyInPandasWithState(flush, out, "first long, last long, n long", "append", "EventTimeTimeout")


def affected(changed: DataFrame, deleted: DataFrame, edges: DataFrame, imports: DataFrame, unresolved: DataFrame, exported: DataFrame) -> DataFrame:
    """file of everything to resolve again: changed files, importers of changed or deleted ones, holders of edges into
    deleted ones, and files whose unresolved names are now exported; deleted files themselves are left out."""
    touched = changed.select("file").union(deleted.select("file"))
    importers = imports.join(touched.select(F.col("file").alias("resolved")), "resolved", "left_semi").select("file")
    target = F.substring_index("dst", "::", 1)
    holders = edges.withColumn("target", target).join(deleted.select(F.col("file").alias("target")), "target", "left_semi").select("file")
    named = unresolved.join(exported.select("name").distinct(), "name", "left_semi").select("file")
    return changed.select("file").union(importers).union(holders).union(named).distinct().join(deleted.select("file"), "file", "left_anti")


def analysis_due(churn: int, waiting: int, analysed_before: bool, *, most: int = 20, total: int = 50) -> tuple[bool, int]:
    """(whether to analyse now, files that wait): small changes wait until enough have gathered."""
    waiting += churn
    if analysed_before and churn <= most and waiting <= total:
        return False, waiting
    return True, 0
