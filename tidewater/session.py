"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tasks for each shuffle partition where a task's memory would follow the whole table.
FINER = 4
#: Folders of the tables that were settled in the innermost :func:`workshop`.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def session(app: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; Arrow batches bounded by bytes as well as by rows."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "64m"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share: ``spark.checkpoint.dir``; only a local master may do without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    return (named or "/tmp/checkpoints/tidewater").rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs here gives its shuffle files back when it ends, and not when the driver next collects garbage. For writes and looks that nobody repeats: a frame that runs again makes its shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: a lost executor costs tasks and not the plan before it. The table goes with its :func:`workshop`, or else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def workshop(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables settled inside go when it ends, so that no more of them stand at once than are read. What is read outside is settled by the function that it yields."""
    outer = _MADE.get()
    made: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        inside = _MADE.set(outer)
        try:
            return settled(df, label)
        finally:
            _MADE.reset(inside)

    here = _MADE.set(made)
    try:
        yield kept
    finally:
        _MADE.reset(here)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of each key in one task, in ``FINER`` times the session's shuffle partitions, so that what a task sorts or sums is a small part of a large table.

    Windows, sums and joins by these keys, or sums by more than these, need no other shuffle.
    """
    return df.repartition(FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
