"""Session settings and durable intermediate results."""

from __future__ import annotations

import gc
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A shuffle starts with many partitions and joins small ones, so that a task's rows do not grow with the input.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.parquet.compression.codec": "zstd",
    # Rows in memory are several times the size of their files, by which Spark decides what to broadcast through the driver.
    "spark.sql.sources.fileCompressionFactor": "5",
}


class _Scopes(threading.local):
    """Tables of the scopes open in a thread: those that other threads write meanwhile are not theirs."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def build_session(name: str = "shelfsense", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = tune(builder.getOrCreate())
    if not spark.sparkContext.master.startswith("local["):
        ship_package(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that every job here relies on."""
    for key, value in _RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors share one disk, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="shelfsense-")
        context.setCheckpointDir(named)
        return named
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there afterwards.

    A Parquet table rather than an RDD checkpoint: the rows are computed once (a checkpoint runs
    its last stage twice), stored compressed, and later readers fetch only the columns they use.
    Row order is not kept; ordered jobs carry a position column.
    """
    spark = df.sparkSession
    path = durable_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_even(df: DataFrame) -> DataFrame:
    """``durable`` with the rows dealt evenly, for tables scanned many times: a table of few files, however
    many rows they hold, would keep few tasks busy."""
    return durable(df.repartition(chunk_count(df.sparkSession)))


def durable_path(spark: SparkSession) -> str:
    """A new folder for a durable table."""
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    return path


@contextmanager
def durable_scope(spark: SparkSession):
    """Delete the durable tables made inside once the block is left, after the write that reads them."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that are done.

    It does once their plans are collected; a driver with memory to spare may not collect them for a whole job.
    """
    gc.collect()
    spark._jvm.System.gc()


def drop_durable(spark: SparkSession) -> None:
    """Delete the tables this application wrote with ``durable``."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def chunk_count(spark: SparkSession) -> int:
    """Range chunks of an ordered job: the shuffle width, and no more than two per core."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(width, 2 * spark.sparkContext.defaultParallelism))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it is not installed."""
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        archive = shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
