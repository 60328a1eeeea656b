"""Days on which rules over trailing windows hold, replayed for all days at once by sweeps of entries and expiries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import dealt


def _day_number(day: str) -> Column:
    return F.unix_date(F.col(day))


def _standing(changes: DataFrame, security: str) -> DataFrame:
    """(security, no, held) of changes (security, no, step): what the steps of all days up to ``no`` add up to. One row a security and day."""
    daily = changes.groupBy(security, "no").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    return daily.withColumn("held", F.sum("step").over(Window.partitionBy(security).orderBy("no")))


def _asked(days: DataFrame, security: str, day: str) -> DataFrame:
    """The days on which a rule is looked up, as changes of nothing."""
    return days.select(security, _day_number(day).alias("no"), F.lit(0).alias("step"), F.lit(True).alias("asked")).distinct()


def _found(changes: DataFrame, asked: DataFrame, security: str, least: int) -> DataFrame:
    rows = changes.select(security, "no", "step", F.lit(False).alias("asked")).unionByName(asked)
    return _standing(rows, security).where((F.col("held") >= least) & F.col("asked")).select(security, F.date_from_unix_date("no").alias("day"), F.col("held").alias("held"))


def crowded_days(buys: DataFrame, security: str, maker: str, day: str, days: int = 30, least: int = 2) -> DataFrame:
    """(security, day, held) of the days with a buy on which at least ``least`` makers bought in the ``days`` up to it, the day included.

    A maker's days become stretches in which it counts: +1 on the first day of a stretch, -1 ``days`` after
    its last. Steps are added up by security and day, and a running sum tells the makers of each day:
    nothing is gathered, and a window holds at most one row a day of a security.
    """
    own = buys.select(security, maker, _day_number(day).alias("no")).dropna().distinct()
    turn = Window.partitionBy(security, maker).orderBy("no")
    apart = own.withColumns({"opens": F.coalesce(F.col("no") - F.lag("no").over(turn) >= days, F.lit(True)), "closes": F.coalesce(F.lead("no").over(turn) - F.col("no") >= days, F.lit(True))})
    steps = apart.where("opens").select(security, "no", F.lit(1).alias("step")).unionByName(apart.where("closes").select(security, (F.col("no") + days).alias("no"), F.lit(-1).alias("step")))
    return _found(steps, _asked(buys.dropna(subset=[security, maker, day]), security, day), security, least)


def heavy_days(buys: DataFrame, asked: DataFrame, security: str, person: str, day: str, amount: str, days: int = 30, least: float = 0.15) -> DataFrame:
    """(security, day, held) of the days of ``asked`` (security, day) on which some person's amounts of the ``days`` up to it come to ``least``.

    A person's sum changes on own days and ``days`` after each; between two changes it stands. Each change
    is summed anew over its window of at most ``days`` daily amounts, so that no sum drifts. A person over
    the mark is +1 until the next change; running sums by security tell how many are. Null amounts add
    nothing.
    """
    known = buys.select(security, person, _day_number(day).alias("no"), F.col(amount).cast("double").alias("v")).dropna(subset=[security, person, "no"])
    # dealt out once, in finer tasks: days, changes and windows stay where a person's rows are
    daily = dealt(known, security, person).groupBy(security, person, "no").agg(F.sum("v").alias("v"))
    turns = F.array(F.struct("no", "v"), F.struct((F.col("no") + days).alias("no"), F.lit(None).cast("double").alias("v")))
    changes = daily.select(security, person, F.explode(turns).alias("change")).groupBy(security, person, F.col("change.no").alias("no")).agg(F.sum("change.v").alias("v"))
    turn = Window.partitionBy(security, person).orderBy("no")
    summed = changes.withColumns({"held": F.sum("v").over(turn.rangeBetween(1 - days, 0)), "next": F.lead("no").over(turn)})
    over = summed.where(F.col("held") >= least)
    steps = over.select(security, "no", F.lit(1).alias("step")).unionByName(over.where("next is not null").select(security, F.col("next").alias("no"), F.lit(-1).alias("step")))
    return _found(steps, _asked(asked.dropna(subset=[security, day]), security, day), security, 1)


def study_events(
    trades: DataFrame, security: str = "security", person: str = "person", maker: str = "maker", role: str = "role", side: str = "side", value: str = "value", share: str = "pct", day: str = "day", token: str = "is_token",
    promoters: tuple[str, ...] = ("promoter", "promoter_group"), officers: tuple[str, ...] = ("director", "kmp"), least_value: float = 25e5, spotlight: float = 0.15, days: int = 30, makers: int = 2,
) -> DataFrame:
    """(security, day, signal, value): what eligible trades signal on the day they were made public.

    Large trades (``least_value`` or more, no token buys) signal by role and side: promoter_buy,
    promoter_sell, officer_buy, officer_sell, one row a trade. ``spotlight``: on a day with any buy some
    decision-maker's buys of the trailing window are at least that share of the company; ``cluster``: on a
    day with a decision-maker's buy enough different makers bought in the window; one row a security and
    day, without a value. Trades without a security or a day signal nothing; a null token is none.
    """
    known = trades.dropna(subset=[security, day]).withColumn("_token", F.coalesce(F.col(token), F.lit(False)))
    is_promoter, is_officer, buy = F.col(role).isin(*promoters), F.col(role).isin(*officers), F.col(side) == "BUY"
    name = F.when(is_promoter & buy, "promoter_buy").when(is_officer & buy, "officer_buy").when(is_promoter & (F.col(side) == "SELL"), "promoter_sell").when(is_officer & (F.col(side) == "SELL"), "officer_sell")
    large = known.where((F.col(value) >= least_value) & ~F.col("_token")).select(F.col(security).alias("security"), F.col(day).alias("day"), name.alias("signal"), F.col(value).alias("value")).where("signal is not null")
    buys = known.where(buy & ~F.col("_token") & (is_promoter | is_officer))
    crowds = crowded_days(buys, security, maker, day, days, makers).select(F.col(security).alias("security"), "day", F.lit("cluster").alias("signal"), F.lit(None).cast("double").alias("value"))
    heavy = heavy_days(buys, known.where(buy), security, person, day, share, days, spotlight).select(F.col(security).alias("security"), "day", F.lit("spotlight").alias("signal"), F.lit(None).cast("double").alias("value"))
    return large.unionByName(heavy).unionByName(crowds)
