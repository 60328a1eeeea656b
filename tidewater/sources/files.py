"""Readers and writers of the reference's file formats as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of the schema where the path does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def delimited(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",") -> DataFrame:
    """Delimited text with a header: file columns (stripped of marks and blanks) renamed, all text. A missing column is an error."""
    raw = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    plain = {c.replace("﻿", "").strip(): c for c in raw.columns}
    missing = [c for c in columns if c not in plain]
    if missing:
        raise ValueError(f"columns not in the file: {missing}")
    return raw.select(*[F.nullif(F.trim(F.col(f"`{plain[c]}`")), F.lit("")).alias(out) for c, out in columns.items()])


def json_rows(spark: SparkSession, path: str, schema: str, rows: str | None = None) -> DataFrame:
    """JSON documents of a declared schema; ``rows`` names an array of records inside each."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df if rows is None else df.select(F.explode(rows).alias("r")).select("r.*")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, body, sha256, length)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"), F.sha2("content", 256).alias("sha256"), "length")


def new_blobs(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs whose content is not stored yet, once each."""
    return found.join(stored.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"])


def body_check(body: Column, expects_html: bool = False) -> Column:
    """``empty``, ``html_instead`` or ``ok`` from the first bytes of a response."""
    head = F.lower(F.ltrim(F.decode(F.substring(body, 1, 200), "ISO-8859-1")))
    return F.when(F.octet_length(body) == 0, "empty").when(~F.lit(expects_html) & (head.startswith("<!doctype html") | head.startswith("<html")), "html_instead").otherwise("ok")


def xml_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Elements of XML files as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def written_table(df: DataFrame, path: str) -> None:
    """Replaces a Parquet table, compressed with zstd."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
