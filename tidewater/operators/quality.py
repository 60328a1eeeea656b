"""Data quality: range checks, coverage, reconciliation and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percent_checks(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 100.0) -> DataFrame:
    """One row a column: rows, nulls, values out of range, the largest size, and whether it looks like fractions."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("cell")).select("cell.*")
    out = cells.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.count_if((F.col("x") < low) | (F.col("x") > high)).alias("out_of_range"), F.max(F.abs("x")).alias("largest"))
    return out.withColumn("fractions", F.coalesce(F.col("largest") <= 1, F.lit(False)))


def coverage(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row a status: both, missing (expected only), extra (found only)."""
    a = found.select(*keys).distinct().withColumn("f", F.lit(True))
    b = expected.select(*keys).distinct().withColumn("e", F.lit(True))
    status = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("both")
    return a.join(b, keys, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def add_up(parts: DataFrame, wholes: DataFrame, keys: list[str], amount: str, tolerance: float) -> DataFrame:
    """Keys where the sum of the parts differs from the whole by more than the tolerance, or one side is missing."""
    a = parts.groupBy(*keys).agg(F.sum(amount).alias("parts"))
    b = wholes.select(*keys, F.col(amount).alias("whole"))
    gap = F.abs(F.col("parts") - F.col("whole")) > tolerance
    return a.join(b, keys, "full").where(F.coalesce(gap, F.lit(True)))


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(source, rows, latest) by table."""
    out = None
    for name, (df, day) in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows"), F.max(F.col(day).cast("date")).alias("latest")).select(F.lit(name).alias("source"), "rows", "latest")
        out = one if out is None else out.unionByName(one)
    return out


def differing_fields(kept: DataFrame, removed: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(field, n): in how many removed rows a field differs from the kept row of the same key."""
    a = kept.select(*keys, *[F.col(c).alias(f"k_{c}") for c in fields])
    joined = removed.join(a, keys)
    return joined.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (~F.col(c).eqNullSafe(F.col(f"k_{c}"))).cast("long").alias("d")) for c in fields])).alias("x")).groupBy("x.field").agg(F.sum("x.d").alias("n"))
