"""Trades: eligibility, decisions, roll-ups, netting, investors and breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.spec import LIMITS


def signed(side: str, amount: str) -> Column:
    """The amount, negative on the sell side."""
    return F.when(F.col(side) == "SELL", -F.col(amount)).otherwise(F.col(amount))


def bought(side: str, amount: str) -> Column:
    return F.when(F.col(side) == "BUY", F.col(amount)).otherwise(0)


def sold(side: str, amount: str) -> Column:
    return F.when(F.col(side) == "SELL", F.col(amount)).otherwise(0)


def in_window(day: str, ref: Column, days: int) -> Column:
    """(ref - days, ref]."""
    return (F.col(day) > F.date_sub(ref, days)) & (F.col(day) <= ref)


def eligible(trades: DataFrame, is_market: Column, needs_review: Column) -> DataFrame:
    """Market trades that need no review; a null flag is false."""
    return trades.where(F.coalesce(is_market, F.lit(False)) & ~F.coalesce(needs_review, F.lit(False)))


def as_of_day(df: DataFrame, day: str, not_after: Column | None = None) -> DataFrame:
    """One row: the latest day of the data, capped by ``not_after``."""
    seen = df if not_after is None else df.where(F.col(day) <= not_after)
    return seen.agg(F.max(day).alias("ref"))


def decisions(trades: DataFrame, ref: Column, side: str = "BUY", days: int = LIMITS.decision_days, history: int = LIMITS.history_days) -> DataFrame:
    """One row a security and decision-maker in the window: sums, days, dates, holding base and prior months.

    Columns read: security, person, side, quantity, value, day_to. ``prior_months``: distinct months with a
    trade of the same side in the ``history`` days before the window.
    """
    own = trades.where(F.col("side") == side)
    start = F.date_sub(ref, days)
    now = F.col("day_to") > start
    before = (F.col("day_to") <= start) & (F.col("day_to") > F.date_sub(start, history))
    grouped = own.where((F.col("day_to") <= ref) & (F.col("day_to") > F.date_sub(start, history))).groupBy("security", "person")
    out = grouped.agg(
        F.count_if(now).alias("trades"),
        F.round(F.sum(F.when(now, F.col("value"))), 2).alias("value"),
        F.sum(F.when(now, F.col("quantity"))).alias("quantity"),
        F.count_distinct(F.when(now, F.col("day_to"))).alias("days"),
        F.min(F.when(now, F.col("day_to"))).alias("first_day"),
        F.max(F.when(now, F.col("day_to"))).alias("last_day"),
        F.count_distinct(F.when(before, F.trunc("day_to", "month"))).alias("prior_months"),
    )
    return out.where("trades > 0")


def qualifies(value: str, days: str, least_value: float = LIMITS.decision_value, steady_days: int = LIMITS.steady_days) -> Column:
    """A decision is large enough, or made on enough days."""
    return (F.col(value) >= least_value) | (F.col(days) >= steady_days)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order, for a report."""
    return df.orderBy(*order).limit(n)


def top_within(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def roll_up_legs(deals: DataFrame, keys: list[str], quantity: str, price: str, row_id: str, feed: str) -> DataFrame:
    """One row a leg: quantity, value, volume-weighted price, legs, distinct feeds and ids in order."""
    out = deals.groupBy(*keys).agg(
        F.sum(quantity).alias("quantity"),
        F.sum(F.col(quantity) * F.col(price)).alias("value"),
        F.count("*").alias("legs"),
        F.array_join(F.array_sort(F.collect_set(feed)), "+").alias("feeds"),
        F.min(row_id).alias("first_id"),
        F.max(row_id).alias("last_id"),
    )
    return out.withColumn("vwap", F.when(F.col("quantity") > 0, F.col("value") / F.col("quantity")))


def net_two_way(legs: DataFrame, keys: list[str], side: str, quantity: str) -> DataFrame:
    """Per key the larger side with the difference of both; keys with equal sides go."""
    grouped = legs.groupBy(*keys).agg(F.sum(bought(side, quantity)).alias("buy"), F.sum(sold(side, quantity)).alias("sell"))
    return grouped.where("buy <> sell").withColumns({"side": F.when(F.col("buy") > F.col("sell"), "BUY").otherwise("SELL"), "net": F.abs(F.col("buy") - F.col("sell"))})


def round_trips(legs: DataFrame, keys: list[str], side: str, quantity: str, tolerance: float = LIMITS.round_trip_tolerance) -> DataFrame:
    """Keys that bought and sold the same amount within the tolerance."""
    grouped = legs.groupBy(*keys).agg(F.sum(bought(side, quantity)).alias("buy"), F.sum(sold(side, quantity)).alias("sell"))
    gap = F.abs(F.col("buy") - F.col("sell"))
    return grouped.where((F.col("buy") > 0) & (F.col("sell") > 0) & (gap <= tolerance * F.greatest("buy", "sell")))


def market_makers(legs: DataFrame, person: str, day: str, side: str, quantity: str, ends: DataFrame, days: int = LIMITS.maker_days, least_legs: int = LIMITS.maker_legs, balance: float = LIMITS.maker_balance) -> DataFrame:
    """(person, period_end) with enough legs, about as much bought as sold, in the ``days`` up to a period's end.

    Legs are first summed by person and day; these sums meet the period ends that they can count for by an
    equi join of stretches of ``days`` days, of which an end lies in a day's own or in the next. Amounts are
    summed as decimals to 8 places, so that a person right at ``balance`` does not depend on the order of rows.
    """
    exact = legs.withColumn(quantity, F.col(quantity).try_cast("decimal(28,8)"))
    daily = exact.groupBy(person, day).agg(F.count("*").alias("legs"), F.sum(bought(side, quantity)).alias("buy"), F.sum(sold(side, quantity)).alias("sell"))
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    placed = daily.withColumn("stretch", F.explode(F.array(stretch(day), stretch(day) + 1)))
    near = placed.join(ends.withColumn("stretch", stretch("period_end")), "stretch").where((F.col(day) <= F.col("period_end")) & (F.col(day) > F.date_sub("period_end", days)))
    grouped = near.groupBy(person, "period_end").agg(F.sum("legs").alias("legs"), F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))
    lower, upper = (f("buy", "sell").cast("decimal(28,8)") for f in (F.least, F.greatest))
    balanced = lower >= F.lit(str(balance)).cast("decimal(9,8)") * upper
    return grouped.where((F.col("legs") >= least_legs) & balanced).withColumns({c: F.col(c).cast("double") for c in ("buy", "sell")})


def handshakes(deals: DataFrame, keys: list[str], person: str, side: str, quantity: str) -> DataFrame:
    """Keys with net sellers and net buyers among persons: what both sides match."""
    net = deals.groupBy(*keys, person).agg(F.sum(signed(side, quantity)).alias("net"))
    both = net.groupBy(*keys).agg(F.sum(F.greatest("net", F.lit(0))).alias("bought"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("sold"), F.count_if(F.col("net") > 0).alias("buyers"), F.count_if(F.col("net") < 0).alias("sellers"))
    return both.where("buyers > 0 and sellers > 0").withColumn("matched", F.least("bought", "sold"))


def net_by(deals: DataFrame, by: list[str], security: str, side: str, value: str) -> DataFrame:
    """Per group: bought, sold, net, deals, securities and the security of the largest net position by size."""
    per = deals.groupBy(*by, security).agg(F.sum(bought(side, value)).alias("b"), F.sum(sold(side, value)).alias("s"), F.count("*").alias("n"))
    largest = F.max_by(F.col(security), F.struct(F.round(F.abs(F.col("b") - F.col("s")), 2), F.col(security)))
    return per.groupBy(*by).agg(F.round(F.sum("b"), 2).alias("bought"), F.round(F.sum("s"), 2).alias("sold"), F.round(F.sum(F.col("b") - F.col("s")), 2).alias("net"), F.sum("n").alias("deals"), F.count("*").alias("securities"), largest.alias("largest"))


def breadth(trades: DataFrame, day: str, ref: Column, days: int, side: str, value: str, security: str, decides: Column, token: Column | None = None) -> DataFrame:
    """One row: rupees and securities that decision-makers bought and sold in the ``days`` to ``ref``, their share of buying in percent, and the same of the period before.

    ``decides`` tells decision-makers' trades; token buys do not count as buys. The period before is null
    where the data begins after it does, its first day aside.
    """
    known = trades.where(F.coalesce(decides, F.lit(False)) & F.col(security).isNotNull() & (F.col(day) <= ref))
    buy = (F.col(side) == "BUY") & ~F.coalesce(token if token is not None else F.lit(False), F.lit(False))
    sell = F.col(side) == "SELL"
    now, before = F.col(day) > F.date_sub(ref, days), (F.col(day) > F.date_sub(ref, 2 * days)) & (F.col(day) <= F.date_sub(ref, days))
    sums = [
        f(c).alias(f"{name}{tail}")
        for tail, window in (("", now), ("_before", before))
        for name, side_is in (("buy", buy), ("sell", sell))
        for name, c, f in ((f"{name}_value", F.when(window & side_is, F.col(value)), lambda x: F.coalesce(F.sum(x), F.lit(0.0))), (f"{name}_securities", F.when(window & side_is, F.col(security)), F.count_distinct))
    ]
    out = known.agg(F.min(day).alias("first"), *sums)
    reaches = F.col("first") <= F.date_add(F.date_sub(ref, 2 * days), 1)
    share = lambda tail: F.when(F.col(f"buy_value{tail}") + F.col(f"sell_value{tail}") > 0, F.col(f"buy_value{tail}") / (F.col(f"buy_value{tail}") + F.col(f"sell_value{tail}")) * 100).alias(f"buy_share{tail}")
    told = out.select("*", share(""), share("_before"))
    return told.select(*(F.when(reaches, F.col(c)).alias(c) if c.endswith("_before") else F.col(c) for c in told.columns if c != "first"))


def person_windows(trades: DataFrame, ref: Column) -> DataFrame:
    """Per security and person the value bought in the last 30 and 90 days."""
    def upto(days: int) -> Column:
        return F.round(F.sum(F.when(in_window("day_to", ref, days), bought("side", "value")).otherwise(0)), 2)

    return trades.where(in_window("day_to", ref, 90)).groupBy("security", "person").agg(upto(30).alias("value_30d"), upto(90).alias("value_90d"))


def clusters(trades: DataFrame, ref: Column, days: int = 30, least: int = 2) -> DataFrame:
    """Securities bought by at least ``least`` decision-makers in the window; ``group`` members count once."""
    maker = F.when(F.col("in_group"), F.lit("GROUP")).otherwise(F.col("person").cast("string"))
    window = trades.where(in_window("day_to", ref, days) & (F.col("side") == "BUY"))
    return window.groupBy("security").agg(F.count_distinct(maker).alias("makers"), F.round(F.sum("value"), 2).alias("value")).where(F.col("makers") >= least)


def blocks(deals: DataFrame, keys: list[str], person: str, price: str, quantity: str, least: int = 3) -> DataFrame:
    """Deals of one key at one price (to one decimal) by at least ``least`` persons as one line.

    Summed by person first; of these only the first three of a line are gathered. Null persons do not count.
    """
    line = [*keys, "price"]
    per = deals.groupBy(*keys, F.round(price, 1).alias("price"), person).agg(F.sum(quantity).alias("q"))
    place = per.withColumn("place", F.row_number().over(Window.partitionBy(*line).orderBy(F.col(person).asc_nulls_last())))
    out = place.groupBy(*line).agg(F.count(person).alias("persons"), F.sum("q").alias("quantity"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.col(person)))).alias("named"))
    return out.where(F.col("persons") >= least)
