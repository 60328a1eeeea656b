"""Helpers that several training-data operators use."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as on one machine in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/tidewater"

#: Spark removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``; only a local master may do without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    This cuts the lineage: a lost executor costs the tasks of one stage and never the whole plan, and
    several consumers of the table do not recompute it. The folder goes when the application ends. Shuffle
    files of the write go as soon as the table stands.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files that no table needs any more, before the next large shuffle."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the bytes of an Arrow batch between Spark and Python in this session, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def text_or_empty(name: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def outputs_over(row: str, df: DataFrame, outputs: list[str]) -> DataFrame:
    """The columns packed in struct ``row`` and ``outputs``; an output replaces an input column of its name."""
    kept = [F.col(row)[f.name].alias(f.name) for f in df.schema[row].dataType.fields if f.name.lower() not in {o.lower() for o in outputs}]
    return df.select(*kept, *outputs)
