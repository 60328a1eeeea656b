"""Decisions by decision-maker: a promoter group counts as one, and sizes are held against its stake and the company's shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.signals import idea_kinds, warnings
from tidewater.spec import LIMITS

# The roles that decide, those of a promoter group, and the floors in percent of the company.
PROMOTERS = ("promoter", "promoter_group")
DECIDES = (*PROMOTERS, "director", "kmp")
LEAST_PCT, ALONE_PCT, SPOTLIGHT_PCT = 0.05, 0.25, 0.15


def _window(trades: DataFrame, ref: Column, side: str, days: int) -> DataFrame:
    """Decision-makers' trades of a side, made public in the ``days`` up to ``ref``; buys without token ones."""
    rows = trades.where((F.col("side") == side) & F.col("role").isin(*DECIDES) & (F.col("seen") <= ref) & (F.col("seen") > F.date_sub(ref, days))).dropna(subset=["security", "person"])
    return rows.where(~F.coalesce(F.col("is_token"), F.lit(False))) if side == "BUY" else rows


def with_makers(rows: DataFrame) -> DataFrame:
    """Rows with ``in_group`` (this filing is a promoter's, or its person is on the group's list) and ``maker``.

    A person belongs to the group if the first filing (by ``turn``) is one of it; the group is led by the
    person of its first filing, who is the maker of all its rows. Anyone else is a maker of his own.
    """
    told = rows.withColumn("in_group", (F.coalesce(F.trim("group_id"), F.lit("")) != "") | F.col("role").isin(*PROMOTERS))
    persons = told.groupBy("security", "person").agg(F.min_by("in_group", "turn").alias("person_in_group"), F.min("turn").alias("first_turn"))
    leads = persons.where("person_in_group").groupBy("security").agg(F.min_by("person", "first_turn").alias("lead"))
    joined = told.join(persons.drop("first_turn"), ["security", "person"]).join(leads, "security", "left")
    return joined.withColumn("maker", F.when(F.col("person_in_group"), F.col("lead")).otherwise(F.col("person"))).drop("person_in_group", "lead")


def decisions_by_maker(trades: DataFrame, shares: DataFrame, ref: Column, side: str = "BUY", days: int = LIMITS.decision_days, history: int = LIMITS.history_days) -> DataFrame:
    """One row a security and decision-maker who traded on that side in the window.

    Columns read of ``trades``: security, person, role, group_id, side, quantity, value, pct (of the market
    cap), is_token, seen (day made public), day_from, day_to, held_before, turn (a total order). ``shares``:
    (security, quarter, total_shares, promoter_shares); the latest quarter that says each counts.

    ``own_change``: what was traded in percent of what those persons held before, who filed it, by each
    one's first trade. ``group_change``: the same for the group's stake. ``prior_months``: months of the
    ``history`` days before with a trade of the side: for the group by any promoter of the company, else by
    the person. ``pct``: of the company's shares, or where these are not known of its market cap.
    """
    rows = with_makers(_window(trades, ref, side, days))
    keys = ["security", "maker"]
    out = rows.groupBy(*keys).agg(
        F.bool_or("in_group").alias("by_group"), F.sum("value").alias("value"), F.sum("quantity").alias("quantity"), F.sum("pct").alias("pct_mcap"), F.count_distinct("day_to").cast("int").alias("days"), F.min("seen").alias("first_day"), F.max("seen").alias("last_day"),
        F.min("day_from").alias("trade_from"), F.max("day_to").alias("trade_to"), F.count("*").alias("filings"), F.count_distinct("person").alias("persons"), F.array_sort(F.collect_set("role")).alias("roles"),
    )
    # the first trade by its first day (none: last), then by when it was made public
    early = F.struct(F.col("day_from").isNull(), "day_from", "seen", "turn")
    person = rows.groupBy(*keys, "person").agg(F.min_by("held_before", early).alias("before"), F.sum("quantity").alias("moved"))
    own = person.where("before > 0").groupBy(*keys).agg(F.sum("before").alias("own_before"), F.sum("moved").alias("own_moved"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("quarter"))).alias(c)
    known = shares.where("security is not null").groupBy("security").agg(latest("total_shares"), latest("promoter_shares"))

    start = F.date_sub(ref, days)
    past = trades.where((F.col("side") == side) & (F.col("seen") <= start) & (F.col("seen") > F.date_sub(start, history))).dropna(subset=["security", "person"]).withColumn("month", F.trunc("seen", "month"))
    group_months = past.where(F.col("role").isin(*PROMOTERS)).groupBy("security").agg(F.count_distinct("month").alias("group_months"))
    own_months = past.groupBy("security", F.col("person").alias("maker")).agg(F.count_distinct("month").alias("own_months"))
    joined = out.join(own, keys, "left").join(known, "security", "left").join(group_months, "security", "left").join(own_months, keys, "left")
    share = lambda part, whole: F.when(whole > 0, part / whole * 100)
    return joined.select(
        *keys, "by_group", "value", "quantity", "days", "first_day", "last_day", "trade_from", "trade_to", "filings", "persons", "roles", share(F.col("own_moved"), F.col("own_before")).alias("own_change"),
        F.when(F.col("by_group"), share(F.col("quantity"), F.col("promoter_shares"))).alias("group_change"), F.coalesce(F.when(F.col("by_group"), F.col("group_months")).otherwise(F.col("own_months")), F.lit(0)).alias("prior_months"),
        F.coalesce(share(F.col("quantity"), F.col("total_shares")), F.col("pct_mcap")).alias("pct"), F.when(F.col("total_shares") > 0, "shares").otherwise("value").alias("pct_basis"), F.when(F.col("quantity") != 0, F.col("value") / F.col("quantity")).alias("avg_price"),
    )


def large_enough(least_value: float = LIMITS.decision_value, least_pct: float = LEAST_PCT, alone_pct: float = ALONE_PCT, steady_days: int = LIMITS.steady_days, big_value: float = LIMITS.big_value) -> Column:
    """Which decisions count: a value that is a share of the company too, a large share alone, steady trading, or a very large value."""
    rule = ((F.col("value") >= least_value) & (F.col("pct") >= least_pct)) | (F.col("pct") >= alone_pct) | (F.col("days") >= steady_days) | (F.col("value") >= big_value)
    return F.coalesce(rule, F.lit(False))


def crowds(trades: DataFrame, ref: Column, days: int = 30) -> DataFrame:
    """(security) with two decision-makers or more buying in the last ``days``."""
    return with_makers(_window(trades, ref, "BUY", days)).groupBy("security").agg(F.count_distinct("maker").alias("makers")).where("makers >= 2").select("security")


def spotlights(trades: DataFrame, ref: Column, days: int = 30, least_pct: float = SPOTLIGHT_PCT) -> DataFrame:
    """(security) of which one person bought ``least_pct`` percent or more in the last ``days``."""
    sums = _window(trades, ref, "BUY", days).groupBy("security", "person").agg(F.sum("pct").alias("pct"))
    return sums.where(F.col("pct") >= least_pct).select("security").distinct()


def ideas(trades: DataFrame, shares: DataFrame, ref: Column, days: int = LIMITS.decision_days, **floors: float) -> DataFrame:
    """One row a security with qualified buying: sums over its decision-makers, and why it is listed."""
    own = decisions_by_maker(trades, shares, ref, "BUY", days).where(large_enough(**floors)).withColumn("person", F.col("maker"))
    officer = F.arrays_overlap("roles", F.array(F.lit("director"), F.lit("kmp")))
    return idea_kinds(own, F.col("by_group"), officer, F.col("days") >= floors.get("steady_days", LIMITS.steady_days), crowds(trades, ref), spotlights(trades, ref))


def cautions(trades: DataFrame, shares: DataFrame, ref: Column, days: int = LIMITS.decision_days, **floors: float) -> DataFrame:
    """One row a security that its promoters sold past the floors of buying, or an officer for a very large value."""
    own = decisions_by_maker(trades, shares, ref, "SELL", days)
    return warnings(own, F.col("by_group"), large_enough(**floors), floors.get("big_value", LIMITS.big_value))
