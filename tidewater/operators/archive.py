"""An append-only archive: merge by key, backfill, clean view and retry state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("at = 1").drop("at")


def merge(archive: DataFrame, new: DataFrame, keys: list[str], run_day: Column, lossless: list[str] = ()) -> DataFrame:
    """Upsert: new values win, ``first_seen`` stays, ``last_seen`` becomes the run's day, lossless columns keep an archived value over null.

    ``archive`` has the columns of ``new`` (one row a key) and first_seen, last_seen. Archived rows without
    a new version stay as they are.
    """
    values = [c for c in new.columns if c not in keys]
    a = archive.withColumn("in_archive", F.lit(True)).withColumnsRenamed({c: f"old_{c}" for c in values})
    both = new.withColumn("in_new", F.lit(True)).join(a, keys, "full")

    def pick(c: str) -> Column:
        newest = F.coalesce(c, f"old_{c}") if c in lossless else F.col(c)
        return F.when(F.col("in_new"), newest).otherwise(F.col(f"old_{c}")).alias(c)

    return both.select(*keys, *[pick(c) for c in values], F.coalesce("first_seen", run_day).alias("first_seen"), F.when(F.col("in_new"), run_day).otherwise(F.col("last_seen")).alias("last_seen"))


def backfill(archive: DataFrame, new: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """The archive with holes of the listed columns filled, and rows whose key it lacks added."""
    values = [c for c in new.columns if c not in keys]
    other = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("in_new"))
    both = archive.withColumn("in_archive", F.lit(True)).join(other, keys, "full")
    return both.select(*keys, *[F.when(F.col("in_archive").isNull(), F.col(f"new_{c}")).otherwise(F.coalesce(c, f"new_{c}") if c in fill else F.col(c)).alias(c) for c in values])


def clean_view(archive: DataFrame, kept: str = "kept") -> DataFrame:
    """Rows that are kept, without the archive's own columns."""
    return archive.where(F.coalesce(F.col(kept), F.lit(True))).drop("first_seen", "last_seen", kept, "drop_reason")


def possibly_withdrawn(archive: DataFrame, day: str, run_day: Column, window: int) -> DataFrame:
    """Rows within the re-read window that the latest run did not see again."""
    return archive.where((F.col("last_seen") < run_day) & (F.col(day) > F.date_sub(run_day, window)))


def pending(wanted: DataFrame, tried: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Wanted keys that are not done and have fewer than ``most`` tries. ``tried``: (key, done, tries)."""
    closed = tried.where(F.col("done") | (F.col("tries") >= most)).select(key)
    return wanted.join(closed, key, "left_anti")


def due(wanted: DataFrame, fetched: DataFrame, key: str, now: Column, age_days: int, n: int) -> DataFrame:
    """The next n keys: those never fetched, then the longest ago, if older than ``age_days``."""
    out = wanted.join(fetched, key, "left").where(F.col("fetched").isNull() | (F.col("fetched") < F.date_sub(now, age_days)))
    return out.orderBy(F.col("fetched").asc_nulls_first(), key).limit(n)


def write_partitioned(df: DataFrame, path: str, day: str, spread: int = 16) -> None:
    """Writes year and quarter partitions of a day column; only partitions in ``df`` are replaced.

    The days of a quarter are dealt to at most ``spread`` tasks, which bounds its files; a single day that
    is too large for a task is split by its rows' hash.
    """
    placed = df.withColumns({"year": F.year(day), "quarter": F.quarter(day)})
    turn = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]), F.lit(spread))
    placed.repartition("year", "quarter", turn).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path)


def event_id(columns: list[str]) -> Column:
    """A stable id of the named columns' content, whatever their order."""
    return F.sha1(F.to_json(F.struct(*sorted(columns))).cast("binary"))
