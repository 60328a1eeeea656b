"""Removal of repeated and superseded records, with a reason for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.spec import LIMITS


def latest_first(df: DataFrame, keys: list[str | Column], order: list[Column], reason: Column | str = "duplicate") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): per key the first row in ``order``, which must be total; null keys are equal."""
    place = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("place", F.row_number().over(place))
    why = F.lit(reason) if isinstance(reason, str) else reason
    return ranked.where("place = 1").drop("place"), ranked.where("place > 1").drop("place").withColumn("reason", why)


def reasons_report(removed: DataFrame, table: str, row_id: str, examples: int = LIMITS.examples) -> DataFrame:
    """(table_name, reason, n, examples): removed rows counted by reason, with the smallest ids as examples.

    Ranked by id before they are gathered, so that a reason with very many rows gathers only its examples.
    """
    place = Window.partitionBy("reason").orderBy(row_id)
    counts = removed.groupBy("reason").agg(F.count("*").alias("n"))
    some = removed.select("reason", row_id).withColumn("place", F.row_number().over(place)).where(F.col("place") <= examples)
    listed = some.groupBy("reason").agg(F.array_sort(F.collect_list(row_id)).alias("examples"))
    return counts.join(listed, "reason").select(F.lit(table).alias("table_name"), "reason", "n", "examples")


def copies_in_other_feed(df: DataFrame, keys: list[str], feed: str, stays: str) -> DataFrame:
    """Rows that do not repeat, in another feed, the key of a row of the feed that stays."""
    kept = df.where(F.col(feed) == stays).select(*[F.col(k).alias(f"k_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    others = df.where(~F.coalesce(F.col(feed) == stays, F.lit(False))).join(kept, same, "left_anti")
    return df.where(F.col(feed) == stays).unionByName(others)


def disjoint_refilings(df: DataFrame, keys: list[str], before: str, after: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of one key whose sets of holdings before and after do not meet: all but the first in ``order`` go.

    Where the sets meet, the rows are tranches of one move, and all stay.
    """
    group = Window.partitionBy(*keys)
    marked = df.withColumns(
        {
            "meets": F.coalesce(F.arrays_overlap(F.collect_set(before).over(group), F.collect_set(after).over(group)), F.lit(False)),
            "place": F.row_number().over(group.orderBy(*order)),
        }
    )
    stays = F.col("meets") | (F.col("place") == 1)
    return marked.where(stays).drop("meets", "place"), marked.where(~stays).drop("meets", "place").withColumn("reason", F.lit("refiled"))


def newest_revision(df: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """Every row with ``superseded``: a later revision of its key exists; null revisions are earliest."""
    return df.withColumn("superseded", F.coalesce(F.col(revision) < F.max(revision).over(Window.partitionBy(*keys)), F.max(revision).over(Window.partitionBy(*keys)).isNotNull()))


def superseded_by_single(df: DataFrame, keys: list[str], row_id: str, time: str, is_revision: str) -> DataFrame:
    """Revisions with ``status``: they replace the one earlier filing of their key, or it is ambiguous, or there is none.

    The smallest and the largest id of the earlier filings run along a key's rows in time, so that no
    pairs are made. Null keys or times have no earlier filing; rows that say neither do not count.
    """
    told = [F.col(k).isNotNull() for k in [*keys, time]]
    sound = told[0]
    for t in told[1:]:
        sound = sound & t
    before = Window.partitionBy(*keys).orderBy(F.col(time), F.col(is_revision).cast("int").desc()).rowsBetween(Window.unboundedPreceding, -1)
    original = F.when(~F.col(is_revision) & sound, F.col(row_id))
    marked = df.where(F.col(is_revision).isNotNull()).withColumns({"lo_id": F.min(original).over(before), "hi_id": F.max(original).over(before)})
    one = sound & (F.col("lo_id") == F.col("hi_id"))
    status = F.when(~sound | F.col("lo_id").isNull(), "no_original").when(one, "replaces").otherwise("ambiguous")
    return marked.where(F.col(is_revision)).withColumns({"original": F.when(one, F.col("lo_id")), "status": status}).drop("lo_id", "hi_id")
