"""Price series: sessions, adjustment, highs, forward returns and event spacing. Series stay long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.spec import LIMITS


def numbered_sessions(days: DataFrame, day: str) -> DataFrame:
    """(day, session_no) of the distinct days in order. A calendar: one row a session, some hundreds a year."""
    return days.where(F.col(day).isNotNull()).select(F.col(day).alias("day")).distinct().withColumn("session_no", F.row_number().over(Window.orderBy("day")).cast("long"))


def sessions_upto(df: DataFrame, sessions: DataFrame, day: str, out: str) -> DataFrame:
    """Every row with the number of sessions on or before its day.

    The distinct days and the sessions meet in one window, in which the last session number is carried
    on: both are calendars of some hundreds of rows a year. The rows join the answers by equality.
    """
    asked = df.select(F.col(day).alias("asked")).where(F.col(day).isNotNull()).distinct()
    both = sessions.select(F.col("day").alias("asked"), "session_no", F.lit(0).alias("side")).unionByName(asked.withColumns({"session_no": F.lit(None).cast("long"), "side": F.lit(1)}))
    upto = Window.orderBy("asked", "side").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn(out, F.coalesce(F.last("session_no", ignorenulls=True).over(upto), F.lit(0))).where("side = 1").select("asked", out)
    return df.join(known, F.col(day) == F.col("asked"), "left").drop("asked")


def daily_bars(prints: DataFrame, key: str, day: str, value: str, quantity: str) -> DataFrame:
    """(key, day, close, low, high, quantity, value): the volume-weighted price as close, and the day's range."""
    price = F.col(value) / F.col(quantity)
    out = prints.where(F.col(quantity) > 0).groupBy(key, day).agg(F.min(price).alias("low"), F.max(price).alias("high"), F.sum(quantity).alias("quantity"), F.sum(value).alias("value"))
    return out.withColumn("close", F.col("value") / F.col("quantity"))


def preferred_series(prices: DataFrame, keys: list[str], rank: Column, *ties: Column) -> DataFrame:
    """One row a key by series preference."""
    return prices.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, *ties))).where("at = 1").drop("at")


def implied_factors(bars: DataFrame, key: str, day: str, close: str, structural: float = 0.05, minor: float = 0.001) -> DataFrame:
    """Every bar with its previous close, the factor between them and the kind of move."""
    w = Window.partitionBy(key).orderBy(day)
    out = bars.withColumns({"prev_close": F.lag(close).over(w), "gap_days": F.datediff(day, F.lag(day).over(w))})
    move = F.abs(F.col("factor") - 1)
    out = out.withColumn("factor", F.when(F.col("prev_close") > 0, F.col(close) / F.col("prev_close")))
    return out.withColumn("kind", F.when(F.col("factor").isNull(), "unknown").when(move > structural, "large").when(move > minor, "minor").otherwise("none"))


def adjusted_close(bars: DataFrame, factors: DataFrame, key: str, day: str, close: str, as_of: Column | None = None) -> DataFrame:
    """Every bar with ``cum_factor``, the product of its key's factors after its day (up to ``as_of``), and ``adjusted``.

    Bars and factors meet in one window by key: a running sum of logarithms from the last day back, which
    adds each factor once. Factors are positive; others do not count.
    """
    sound = factors.where(F.col("factor") > 0)
    if as_of is not None:
        sound = sound.where(F.col(day) <= as_of)
    facts = sound.select(key, day, F.log("factor").alias("ln"))
    both = bars.select(key, day, F.struct("*").alias("bar")).unionByName(facts, allowMissingColumns=True)
    later = Window.partitionBy(key).orderBy(F.col(day).cast("timestamp").cast("long").desc()).rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("cum_factor", F.exp(F.coalesce(F.sum("ln").over(later), F.lit(0.0)))).where("bar is not null")
    return out.select("bar.*", "cum_factor", (F.col(f"bar.{close}") * F.col("cum_factor")).alias("adjusted"))


def price_jumps(bars: DataFrame, key: str, day: str, close: str, explained: DataFrame, threshold: float = LIMITS.jump, most_gap: int = 10) -> DataFrame:
    """Bars that moved by at least the threshold, with why: a filed action since the previous bar, a gap, or nothing."""
    moved = implied_factors(bars, key, day, close).where(F.abs(F.col("factor") - 1) >= threshold)
    actions = explained.select(F.col(key).alias("a_key"), F.col(day).alias("a_day"))
    hit = moved.join(actions, (F.col(key) == F.col("a_key")) & (F.col("a_day") <= F.col(day)) & (F.col("a_day") > F.date_sub(F.col(day), F.col("gap_days"))), "left_semi").select(F.col(key).alias("h_key"), F.col(day).alias("h_day"), F.lit(True).alias("filed"))
    out = moved.join(hit, (F.col(key) == F.col("h_key")) & (F.col(day) == F.col("h_day")), "left").drop("h_key", "h_day")
    return out.withColumn("status", F.when(F.col("filed"), "action_filed").when(F.col("gap_days") > most_gap, "after_gap").otherwise("unexplained")).drop("filed")


def rolling_high(bars: DataFrame, key: str, day: str, close: str, rows: int = LIMITS.high_rows, least: int = LIMITS.high_least) -> DataFrame:
    """Every bar with the highest close of its last ``rows`` bars and the distance from it in percent; null before ``least`` bars."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-(rows - 1), 0)
    enough = F.count("*").over(w) >= least
    out = bars.withColumn("high_close", F.when(enough, F.max(close).over(w)))
    return out.withColumn("from_high_pct", (F.col(close) / F.col("high_close") - 1) * 100)


def forward_returns(events: DataFrame, bars: DataFrame, sessions: DataFrame, key: str, day: str, close: str, horizons: tuple[int, ...] = LIMITS.horizons, cost: float = LIMITS.cost) -> DataFrame:
    """Every event with ``entry`` and ``r_<n>``: entry at the first session after its day, exit n sessions on, less cost, in percent.

    A security's prints, one a session, look ahead by their session's number; so a print has all prices of
    an entry there, no print is sent on more than once for it, and events are joined once. Null where a
    session has no print.
    """
    placed = sessions_upto(events, sessions, day, "before").withColumn("entry_no", F.col("before") + 1)
    numbered = bars.join(sessions.withColumnRenamed("day", "s_day"), F.col(day) == F.col("s_day")).select(F.col(key).alias("p_key"), F.col("session_no").alias("p_no"), F.col(close).alias("p_close"))
    prints = numbered.repartition("p_key").groupBy("p_key", F.col("p_no").alias("p_entry")).agg(F.max("p_close").alias("x_0"))
    ahead = Window.partitionBy("p_key").orderBy("p_entry")
    entries = prints.select("p_key", "p_entry", "x_0", *(F.max("x_0").over(ahead.rangeBetween(n, n)).alias(f"x_{n}") for n in horizons))
    out = placed.join(entries, (F.col(key) == F.col("p_key")) & (F.col("entry_no") == F.col("p_entry")), "left").withColumn("entry", F.col("x_0"))
    returns = {f"r_{n}": (F.col(f"x_{n}") / F.col("entry") - 1) * 100 - cost for n in horizons}
    return out.withColumns(returns).drop("before", "entry_no", "p_key", "p_entry", *(f"x_{n}" for n in (0, *horizons)))


def return_summary(returns: DataFrame, by: str, horizons: tuple[int, ...] = LIMITS.horizons) -> DataFrame:
    """Per signal and horizon: cases, mean, median, share above zero and the half-width of a 90 % interval."""
    pairs = ", ".join(f"{n}, r_{n}" for n in horizons)
    long = returns.select(by, F.expr(f"stack({len(horizons)}, {pairs}) as (horizon, r)")).where("r is not null")
    return long.groupBy(by, "horizon").agg(F.count("*").alias("cases"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.avg((F.col("r") > 0).cast("double")).alias("up_share"), (1.645 * F.stddev_samp("r") / F.sqrt(F.count("*"))).alias("half_width"))


def verdict(summary: DataFrame, least: int = LIMITS.evidence_cases) -> DataFrame:
    """Every row with what its interval says."""
    low, high = F.col("mean") - F.col("half_width"), F.col("mean") + F.col("half_width")
    return summary.withColumn("verdict", F.when(F.col("cases") < least, "few").when(low > 0, "positive").when(high < 0, "drag").otherwise("no_edge"))


def spaced(events: DataFrame, keys: list[str], number: str, apart: int = LIMITS.spacing) -> DataFrame:
    """(keys, number): per key the first event and each that comes at least ``apart`` after the last kept.

    The rule depends on what was kept before, so a key's distinct numbers are folded in order; they are
    sessions, at most as many as the calendar has.
    """
    kept = F.aggregate(F.array_sort(F.collect_set(number)), F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= apart), F.concat(acc, F.array(x))).otherwise(acc))
    return events.groupBy(*keys).agg(kept.alias("kept")).select(*keys, F.explode("kept").alias(number))


def average_daily_value(bars: DataFrame, key: str, day: str, value: str, sessions: int = 20) -> DataFrame:
    """Per key the mean value of its last ``sessions`` days."""
    last = bars.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day)))).where(F.col("at") <= sessions)
    return last.groupBy(key).agg(F.avg(value).alias("adv"), F.count("*").alias("days"))


def price_ladder(price: Column, low: Column, high: Column, value: Column, tolerance: float = LIMITS.price_tolerance, far: float = LIMITS.price_far, powers: tuple[int, ...] = LIMITS.price_powers, faces: tuple[int, ...] = LIMITS.face_values) -> Column:
    """Why a filed price is inside a day's range or not; the first reason that holds.

    A filed value that lies inside the range is a price put in the value's place; ``far`` is measured from
    the range with its tolerance.
    """
    lo, hi = low * (1 - tolerance), high * (1 + tolerance)

    def inside(x: Column) -> Column:
        return x.between(lo, hi)

    power = F.lit(False)
    for k in powers:
        power = power | inside(price * 10.0**k) | inside(price / 10.0**k)
    return (
        F.when(price.isNull() | low.isNull() | high.isNull() | (price <= 0), "no_price")
        .when(inside(price), "inside")
        .when(power, "power_of_ten")
        .when(inside(1 / price), "swapped")
        .when(F.coalesce(inside(value), F.lit(False)), "value_is_price")
        .when(price.isin(*[float(f) for f in faces]) & (price < lo * (1 - far)), "face_value")
        .when(price < lo * (1 - far), "far_below")
        .when(price > hi * (1 + far), "far_above")
        .when(price < lo, "below")
        .otherwise("above")
    )


def holding_state(before: Column, after: Column, quantity: Column, side: Column) -> Column:
    """Whether the change in a holding agrees with the quantity (1 % or one) and the side."""
    delta = after - before
    size_ok = F.abs(F.abs(delta) - quantity) <= F.greatest(quantity * 0.01, F.lit(1.0))
    against = delta * F.when(side == "SELL", -1).otherwise(1) < 0
    return (
        F.when(side.isNull(), "not_applicable")
        .when(delta.isNull() | (F.coalesce(quantity, F.lit(0)) <= 0), "not_filed")
        .when(size_ok & ~against, "match")
        .when(size_ok, "against_side")
        .when(against, "against_side_and_differs")
        .otherwise("differs")
    )
