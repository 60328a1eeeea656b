"""A group's results of a quarter: figures compared with a year ago, medians, movers and rollups. A row is one company's filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.ranking import numbered_within

# The revenue a year ago from which growth is ranked, and the companies from which a median is shown.
REAL_BASE, ROLLUP_LEAST = 1e8, 3


def compared(filings: DataFrame) -> DataFrame:
    """Filings (security, doubt, half, revenue, revenue_growth, profit, profit_before) with profit growth, margin, the revenue a year ago and swings.

    Profit growth needs a profit a year ago: a loss then is a swing and no rate. The margin needs revenue.
    ``counts`` says that a row is compared: not held back by a doubt and not of a half year only.
    """
    profit, before, revenue = F.col("profit"), F.col("profit_before"), F.col("revenue")
    no_doubt = F.coalesce("doubt", F.lit("")) == ""
    return filings.withColumns({
        "profit_growth": F.when(before > 0, (profit / before - 1) * 100), "margin": F.when(revenue > 0, profit / revenue * 100), "base": F.try_divide(revenue, 1 + F.col("revenue_growth") / 100),
        "to_profit": F.coalesce((before < 0) & (profit >= 0), F.lit(False)), "to_loss": F.coalesce((before >= 0) & (profit < 0), F.lit(False)), "held": ~no_doubt, "counts": no_doubt & ~F.coalesce("half", F.lit(False)),
    })


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): the exact median of the values by key, nulls left out; of an even number the mean of the middle two.

    Values are numbered over range-sorted stretches, so no key's values are gathered. Null keys are one key.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    sizes = known.groupBy(*[F.col(k).alias(f"s_{k}") for k in keys]).agg(F.count("*").alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    middle = numbered_within(known, keys, [F.col(value)]).join(sizes, same).where(F.col("place").between(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)))
    return middle.groupBy(*keys).agg(F.avg(value).alias(out))


def _with_medians(sums: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``sums`` with the medians of both growths; a key without any has null."""
    for value, out in (("revenue_growth", "revenue_median"), ("profit_growth", "profit_median")):
        side = medians(rows, keys, value, out).withColumnsRenamed({k: f"m_{k}" for k in keys})
        sums = sums.join(side, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys], "left").drop(*[f"m_{k}" for k in keys])
    return sums


def kpis(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The figures of each group of ``compared`` rows: companies, held back, half years only, growths, swings and those without revenue."""
    def up(c: str) -> Column:
        return F.count_if(F.col("counts") & (F.col(c) > 0))

    def known(c: str) -> Column:
        return F.count(F.when(F.col("counts"), F.col(c)))

    sums = rows.groupBy(*keys).agg(
        F.count_distinct("security").alias("reported"), F.count_if("held").alias("held"), F.count_if(~F.col("held") & F.coalesce("half", F.lit(False))).alias("half"), known("revenue_growth").alias("revenue_n"), up("revenue_growth").alias("revenue_up"),
        known("profit_growth").alias("profit_n"), up("profit_growth").alias("profit_up"), F.count_if(F.col("counts") & F.col("to_profit")).alias("to_profit"), F.count_if(F.col("counts") & F.col("to_loss")).alias("to_loss"), F.count_if(F.col("counts") & F.col("revenue").isNull()).alias("no_revenue"),
    )
    return _with_medians(sums, rows.where("counts"), keys)


def movers(rows: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """(keys, direction, place, security, revenue_growth): the most grown and the most shrunk of each group, from a real revenue a year ago; ties by security."""
    real = rows.where(F.col("counts") & (F.col("base") >= REAL_BASE) & (F.col("revenue_growth") != 0))
    turned = real.select(*keys, F.when(F.col("revenue_growth") > 0, "grown").otherwise("shrunk").alias("direction"), "security", "revenue_growth", F.abs("revenue_growth").alias("size"))
    placed = numbered_within(turned, [*keys, "direction"], [F.desc("size"), F.asc_nulls_last("security")])
    return placed.where(F.col("place") <= most).select(*keys, "direction", "place", "security", "revenue_growth")


def rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Companies, those compared, medians and how many grew, by a classification; groups without a name or with too few to compare are left out."""
    named = rows.where("counts").dropna(subset=keys)
    sums = named.groupBy(*keys).agg(F.count_distinct("security").alias("companies"), F.count("revenue_growth").alias("compared"), F.count_if(F.col("revenue_growth") > 0).alias("revenue_up")).where(F.col("compared") >= ROLLUP_LEAST)
    return _with_medians(sums, named, keys)
