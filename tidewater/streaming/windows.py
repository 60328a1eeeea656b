"""Streaming forms of the incremental operators, for a stream or a batch alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import archive


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Streams keep watermarks on timestamps with a zone only; the session's zone is UTC."""
    if events.isStreaming and isinstance(events.schema[time].dataType, T.TimestampNTZType):
        return events.withColumn(time, F.col(time).cast("timestamp"))
    return events


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Counts and sums by window of fixed width; rows later than ``late`` behind the newest are dropped in a stream."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def gap_sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    """Sessions by key, closed by a gap."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose keys did not come before within the watermark."""
    return _timed(events, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def merge_into(path: str, keys: list[str], day: str, schema: T.StructType):
    """A ``foreachBatch`` sink: merges each batch into the partitioned archive at ``path``; replays change nothing.

    Only year and quarter partitions that a batch touches are read and replaced.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        values = [c for c in schema.fieldNames()]
        stored = T.StructType([*schema.fields, T.StructField("first_seen", T.DateType()), T.StructField("last_seen", T.DateType())])
        fresh = archive.last_per_key(batch.select(*values), keys, F.desc(day), F.desc(F.xxhash64(*values)))
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
        parts = fresh.select(F.year(day).alias("year"), F.quarter(day).alias("quarter")).distinct()
        old = spark.read.schema(T.StructType([*stored.fields, T.StructField("year", T.IntegerType()), T.StructField("quarter", T.IntegerType())])).parquet(path).join(parts, ["year", "quarter"], "left_semi").drop("year", "quarter") if exists else spark.createDataFrame([], stored)
        merged = archive.merge(old, fresh, keys, F.lit(None).cast("date"))
        archive.write_partitioned(merged.withColumns({"first_seen": F.coalesce("first_seen", F.to_date(day)), "last_seen": F.coalesce("last_seen", F.to_date(day))}), path, day)

    return merge_batch
