"""Funds' holdings between month-ends, share counts and roll-ups by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import dealt


def renamed_securities(now: DataFrame, before: DataFrame, house: str, security: str, name: str) -> DataFrame:
    """(old, new): a house's security that went and one that came under the same name, one to one; a security that houses map differently is left out."""
    here = now.select(house, security, name).distinct()
    there = before.select(house, security, name).distinct()
    gone = there.join(here.select(house, security).distinct(), [house, security], "left_anti")
    came = here.join(there.select(house, security).distinct(), [house, security], "left_anti")

    def single(df: DataFrame, out: str) -> DataFrame:
        return df.where(F.length(name) > 0).groupBy(house, name).agg(F.count("*").alias("n"), F.min(security).alias(out)).where("n = 1").drop("n")

    pairs = single(gone, "old").join(single(came, "new"), [house, name])
    return pairs.groupBy("old").agg(F.min("new").alias("new"), F.count_distinct("new").alias("n")).where("n = 1").drop("n")


def on_new_names(before: DataFrame, renames: DataFrame, security: str) -> DataFrame:
    """The earlier holdings with each renamed security under its new name."""
    named = before.join(renames, F.col(security) == F.col("old"), "left")
    return named.withColumn(security, F.coalesce("new", security)).drop("old", "new")


def by_security(changes: DataFrame) -> DataFrame:
    """Per security: houses adding, cutting, starting and leaving, net change, holders and the price that holders valued it at.

    ``changes``: (security, house, kind, change, after, value), one row a house. The price is null where no
    house holds it any more.
    """
    holds = F.col("after") > 0
    out = changes.groupBy("security").agg(
        F.count_if(F.col("kind").isin("added", "new")).alias("adding"), F.count_if(F.col("kind").isin("cut", "exit")).alias("cutting"),
        F.count_if(F.col("kind") == "new").alias("starting"), F.count_if(F.col("kind") == "exit").alias("leaving"),
        F.sum("change").alias("net"), F.count_if(holds).alias("holding"), F.sum(F.when(holds, F.col("value"))).alias("v"), F.sum(F.when(holds, F.col("after"))).alias("s"),
    )
    priced = out.withColumn("price", F.when(F.col("s") > 0, F.col("v") / F.col("s")))
    return priced.withColumn("net_value", F.col("net") * F.col("price")).drop("v", "s")


def expected_factors(actions: DataFrame) -> DataFrame:
    """Filed actions (security, purpose, ex_day, new_for, held, face_from, face_to) -> one price factor a security and ex-day.

    A bonus of n new for h held is h / (h + n), a split is the new face value over the old; a day's factors
    multiply. ``expected`` is null where the day has neither, which says that its move is another one.
    An action seen twice counts once. The rows are dealt out once, by security and day.
    """
    purpose = F.lower("purpose")
    bonus = F.when((F.col("new_for") > 0) & (F.col("held") > 0), F.col("held") / (F.col("held") + F.col("new_for")))
    split = F.when((F.col("face_from") > 0) & (F.col("face_to") > 0), F.col("face_to") / F.col("face_from"))
    factor = F.when(purpose == "bonus", bonus).when(purpose == "split", split)
    known = actions.where("security is not null and ex_day is not null").select("security", "ex_day", purpose.alias("purpose"), factor.alias("factor"))
    once = dealt(known, "security", "ex_day").distinct()
    own = F.col("purpose").isin("bonus", "split")
    out = once.groupBy("security", "ex_day").agg(F.exp(F.sum(F.log("factor"))).alias("expected"), F.bool_or(own).alias("split_bonus"), F.bool_or(F.col("purpose").isin("demerger", "scheme")).alias("scheme"))
    return out.withColumn("expected", F.when(F.col("split_bonus"), F.col("expected")))


def share_factors(factors: DataFrame, after: Column, upto: Column) -> DataFrame:
    """(security, factor): what shares held before are multiplied by, for bonuses and splits of (after, upto]."""
    own = factors.where(F.col("split_bonus") & (F.col("expected") > 0) & (F.col("ex_day") > after) & (F.col("ex_day") <= upto))
    return own.groupBy("security").agg((1 / F.exp(F.sum(F.log("expected")))).alias("factor"))


def clean_ratios(most: int = 20, small: int = 5, held: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 10)) -> list[float]:
    """Factors of splits and consolidations of up to ``most``, and of bonuses a for b: both up to ``small``, or b one of ``held`` and a up to b + 1.

    Other b are left out: with 7, 8 or 9 nearly any reset would be near some ratio.
    """
    pairs = {(1, k) for k in range(2, most + 1)} | {(k, 1) for k in range(2, most + 1)}
    pairs |= {(b, a + b) for b in range(1, small + 1) for a in range(1, small + 1)} | {(b, a + b) for b in held for a in range(1, b + 2)}
    return sorted({x / y for x, y in pairs})


def is_clean_ratio(factor: Column, tolerance: float = 0.015) -> Column:
    """Whether a factor is within the tolerance of one that a split, a bonus or a consolidation gives (see :func:`clean_ratios`); null is not."""
    near = F.exists(F.array(*(F.lit(r) for r in clean_ratios())), lambda r: F.abs(factor / r - 1) <= tolerance)
    return F.coalesce(near, F.lit(False))


def missing_previous_session(bars: DataFrame, day: str, base: Column, minor: float = 0.001, share: float = 0.9, least: int = 20) -> DataFrame:
    """Days on which nearly all measurable rows have a base price off the previous close: a session that the layer lacks."""
    out = bars.groupBy(day).agg(F.count(base).alias("n"), F.count_if(F.abs(base - 1) > minor).alias("off"))
    return out.where((F.col("n") >= least) & (F.col("off") >= share * F.col("n")))


def bridged(prices: DataFrame, issuer: Column, most_gap: int = 10) -> DataFrame:
    """(old, new): one symbol's prints that moved from a security to another of the same issuer within ``most_gap`` days.

    ``prices``: (symbol, security, day). Only neighbours in the order of first prints, which do not overlap.
    """
    spans = prices.withColumn("issuer", issuer).where("symbol is not null and security is not null").groupBy("symbol", "issuer", "security").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    w = Window.partitionBy("symbol", "issuer").orderBy("first", "security")
    moved = spans.withColumns({"old": F.lag("security").over(w), "old_last": F.lag("last").over(w)})
    return moved.where((F.col("old_last") < F.col("first")) & (F.datediff("first", "old_last") <= most_gap)).select("symbol", "old", F.col("security").alias("new"))


def rollup(moves: DataFrame, classes: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """Per label: net, bought, sold and securities; without a class 'Not classified'; rows without a value left out."""
    named = moves.where(F.col(value).isNotNull()).join(classes.select(key, label).dropDuplicates([key]), key, "left").withColumn(label, F.coalesce(label, F.lit("Not classified")))
    v = F.col(value)
    return named.groupBy(label).agg(F.round(F.sum(v), 2).alias("net"), F.count_distinct(key).alias("securities"), F.round(F.sum(F.greatest(v, F.lit(0.0))), 2).alias("bought"), F.round(F.sum(F.least(v, F.lit(0.0))), 2).alias("sold"))


def bucket_rollup(moves: DataFrame, buckets: DataFrame, key: str, net: str, value: str) -> DataFrame:
    """Per size bucket: net value, securities net bought, net sold, and all; without a bucket 'No size'."""
    named = moves.join(buckets.select(key, "bucket").dropDuplicates([key]), key, "left").withColumn("bucket", F.coalesce("bucket", F.lit("No size")))
    return named.groupBy("bucket").agg(F.round(F.sum(value), 2).alias("net_value"), F.count_if(F.col(net) > 0).alias("bought"), F.count_if(F.col(net) < 0).alias("sold"), F.count_distinct(key).alias("securities"))


def first_held(months: DataFrame, key: str, month: str, before: str) -> DataFrame:
    """(key, month) of securities that come into the table after its first month, with nothing held before."""
    start = months.agg(F.min(month).alias("start"))
    first = months.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(month))).where("at = 1")
    return first.crossJoin(F.broadcast(start)).where((F.col(month) > F.col("start")) & (F.coalesce(before, F.lit(0)) == 0)).select(key, month)


def by_quarter(categories: DataFrame, security: str, quarter: str, check: Column, labels: dict[str, list[str]], quarters: int = 5) -> DataFrame:
    """(security, quarter, label, pct, change): the latest quarters in long form; a quarter that fails its check is null.

    ``change`` is against the sound quarter before; a label with an unknown part is null.
    """
    nth = F.dense_rank().over(Window.partitionBy(security).orderBy(F.desc(quarter)))
    recent = categories.withColumn("nth", nth).where(F.col("nth") <= quarters).withColumn("sound", F.coalesce(check, F.lit(False)))

    def total(parts: list[str]) -> Column:
        out = F.col(parts[0])
        for p in parts[1:]:
            out = out + F.col(p)
        return out

    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.when(F.col("sound"), total(parts)).alias("pct")) for name, parts in labels.items()]))
    long = recent.select(security, quarter, "sound", rows.alias("r")).select(security, quarter, "sound", "r.*")
    w = Window.partitionBy(security, "label").orderBy(quarter).rowsBetween(Window.unboundedPreceding, -1)
    return long.withColumn("change", F.col("pct") - F.last("pct", ignorenulls=True).over(w)).drop("sound")


def ledger_rows(events: DataFrame, ledger: DataFrame, keys: list[str], day: str, since: Column, recorded: Column) -> DataFrame:
    """Events of the last sessions that the append-only ledger does not have yet, once each, with when they were recorded."""
    fresh = events.where(F.col(day) >= since).join(ledger.select(*keys, day).distinct(), [*keys, day], "left_anti")
    return fresh.dropDuplicates([*keys, day]).withColumn("recorded", recorded)


def basket_nav(positions: DataFrame, bars: DataFrame, cost: float) -> DataFrame:
    """(day, mean_return, nav): the mean daily return of open positions, less cost on entries, compounded from 100.

    ``positions``: (security, entry_day, exit_day null while open); ``bars``: (security, day, close). A
    position earns from the bar after its entry to its exit; days are those of ``bars`` from the first entry.
    The compounding window runs over a calendar: one row a day.
    """
    w = Window.partitionBy("security").orderBy("day")
    moves = bars.withColumn("move", (F.col("close") / F.lag("close").over(w) - 1) * 100)
    first = positions.agg(F.min("entry_day").alias("first"))
    days = bars.select("day").distinct().crossJoin(F.broadcast(first)).where("day >= first").select("day")
    open_ = moves.join(positions, "security").where((F.col("day") > F.col("entry_day")) & (F.col("exit_day").isNull() | (F.col("day") <= F.col("exit_day")))).groupBy("day").agg(F.avg("move").alias("gain"), F.count("*").alias("live"))
    entries = positions.groupBy(F.col("entry_day").alias("day")).agg(F.count("*").alias("entering"))
    daily = days.join(open_, "day", "left").join(entries, "day", "left").na.fill(0, ["gain", "live", "entering"])
    held = F.col("live") + F.col("entering")
    out = daily.withColumn("mean_return", F.col("gain") - F.when(held > 0, cost * F.col("entering") / held).otherwise(0.0))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("day", held.alias("open_positions"), "mean_return", (100 * F.exp(F.sum(F.log1p(F.col("mean_return") / 100)).over(run))).alias("nav"))
