"""Session construction, input loading and durable intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Bytes of an Arrow batch; rows may be long texts.
ARROW_BYTES = 2 << 20


def build(master: str = "local[8]", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session with the settings the engine is tuned for; a cluster brings its own."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    spark = (
        SparkSession.builder.master(master)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it on their path, and bound what a Python worker is
    handed at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in paths or Path.cwd() == ROOT:
        return
    sc = spark.sparkContext
    if any("orbweft" in str(f) for f in getattr(sc, "_python_includes", [])):
        return
    target = Path(tempfile.mkdtemp()) / "orbweft.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "orbweft").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be anything Spark's readers open."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own where it is unset and all is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="orbweft-")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


_WRITTEN: list[str] = []
_AT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear() deletes."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stored(df: DataFrame, name: str, *, partitions: int | None = None, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at durable files.

    Shuffle files that only led to it are deleted once it is written.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        (df.coalesce(partitions) if partitions else df).write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _AT[out] = path
    return out


def forget(*written: DataFrame) -> None:
    """Delete what stored() has written for these; nothing may read them any more."""
    for df in written:
        path = _AT.pop(df)
        _WRITTEN.remove(path)
        delete(df.sparkSession, path)


def delete(spark: SparkSession, uri: str) -> None:
    """Remove a file or folder, wherever Spark can reach it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete what stored() has written; results that still read it must be done with."""
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())
