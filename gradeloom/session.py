"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions and splits skewed ones; the session
# time zone is pinned because every timestamp in the model is naive UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.ui.enabled": "false",
    # HotSpot leaves methods above 8000 bytes of bytecode interpreted; below the
    # limit Spark splits wide expressions into smaller methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call sites for error messages cost several JVM calls per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# On top of the defaults for large tables: start with many shuffle partitions and
# let AQE merge them, so that a partition fits into executor memory at any size.
CLUSTER_CONF = {
    **DEFAULT_CONF,
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """Build a local session with the library defaults (tests and bench)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gradeloom")
    settings = {
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        **DEFAULT_CONF,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Fallback folders by application: spark.checkpoint.dir cannot be set on a running session.
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Return the folder every executor can reach, from ``spark.checkpoint.dir``.

    A local session without that setting gets one temporary folder for each
    application, removed when the interpreter ends; a cluster session without it
    is an error, because a machine-local folder would be lost with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    application = spark.sparkContext.applicationId
    if application not in _FALLBACK:
        folder = tempfile.TemporaryDirectory(prefix="gradeloom-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _FALLBACK[application] = folder.name
    return _FALLBACK[application]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """Return an unused folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{os.urandom(6).hex()}"


def cut_lineage(df):
    """Materialise ``df`` in the shared folder so later reads see the same rows."""
    spark = df.sparkSession
    path = fresh_dir(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver collects its garbage."""
    before = spark.conf.get(REMOVES_SHUFFLES, None)
    spark.conf.set(REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVES_SHUFFLES)
        else:
            spark.conf.set(REMOVES_SHUFFLES, before)


class Scratch:
    """Intermediate tables of a job that hold no disk longer than the job needs them."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def cut(self, df):
        """``cut_lineage`` of ``df``; its shuffle files go at once, the table with ``drop``."""
        spark = df.sparkSession
        path = fresh_dir(spark, "cut")
        with _shuffles_removed(spark):
            df.write.parquet(path)
        self.paths.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete all tables; nothing may read them any more."""
        for spark, path in self.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()
