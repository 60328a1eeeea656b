"""One disclosure shown by two exchanges: links of the second to the first, moved meetings, and one table of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wider than the scale's distance of two values within tolerance (1.0051 at 1 %).
_WIDTH = 1.02


def tolerance_scale(value: Column, relative: float, least: float) -> Column:
    """A scale on which values within ``least``, or within ``relative`` of one of them, lie at most about 1 apart.

    It is linear to where the two tolerances meet and logarithmic beyond. ``relative`` is 0.03 at most.
    """
    turn = least / relative
    beyond = F.signum(value) * (1 / relative + F.log(F.abs(value) / turn) / relative)
    return F.when(F.abs(value) < turn, value / least).otherwise(beyond)


def linked_to_first(second: DataFrame, first: DataFrame, keys: list[str], first_id: str, amount: str | None = None, relative: float = 0.01, least: float = 1.0, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``second`` with ``on_first``, ``first_event_id`` (the smallest id of those that fit) and ``listed_on`` (``second`` or ``second,first``).

    Rows fit when their keys are equal (null fits nothing, but for ``nullable`` keys, where null fits null) and,
    with ``amount``, amounts differ by no more than ``relative`` of the first's or ``least``. Each side is one row
    for equal keys and amounts before the sides meet, and amounts meet in blocks of a tolerance's width,
    own and beside. Several rows may have one partner; none is multiplied.
    """
    by = [*keys, amount] if amount else keys
    firm = [c for c in by if c not in nullable]
    ids = first.dropna(subset=[*firm, first_id]).groupBy(*[F.col(c).alias(f"f_{c}") for c in by]).agg(F.min(first_id).alias("first_event_id"))
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) if c in nullable else F.col(c) == F.col(f"f_{c}") for c in keys]
    if amount:
        block = lambda c: F.floor(tolerance_scale(F.col(c), relative, least) / _WIDTH)
        asked = second.select(*by).dropna(subset=firm).distinct().withColumn("in_block", F.explode(F.array(block(amount) - 1, block(amount), block(amount) + 1)))
        near = F.abs(F.col(amount) - F.col(f"f_{amount}")) <= F.greatest(F.lit(relative) * F.abs(f"f_{amount}"), F.lit(least))
        met = asked.join(ids.withColumn("of_block", block(f"f_{amount}")), [*same, F.col("in_block") == F.col("of_block"), near])
        ids = met.groupBy(*[F.col(c).alias(f"f_{c}") for c in by]).agg(F.min("first_event_id").alias("first_event_id"))
        same = [*same, F.col(amount) == F.col(f"f_{amount}")]
    linked = second.join(ids, same, "left").drop(*[f"f_{c}" for c in by])
    on = F.col("first_event_id").isNotNull()
    return linked.withColumns({"on_first": on, "listed_on": F.when(on, "second,first").otherwise("second")})


def without_moved(meetings: DataFrame) -> DataFrame:
    """Meetings (code, day, intimated, moved) with ``reason``: ``moved`` of rows that list a day as moved away from, ``moved_away`` of a meeting on such a day that was intimated no later than the last move, else null.

    A meeting without a time of its own is gone when a timed move is known; moves without a time, and null codes or days, remove nothing.
    """
    is_move = F.coalesce("moved", F.lit(False))
    moves = meetings.where(is_move).groupBy(F.col("code").alias("m_code"), F.col("day").alias("m_day")).agg(F.max("intimated").alias("moved_at"))
    met = meetings.join(moves, (F.col("code") == F.col("m_code")) & (F.col("day") == F.col("m_day")), "left").drop("m_code", "m_day")
    gone = F.col("moved_at").isNotNull() & F.coalesce(F.col("intimated") <= F.col("moved_at"), F.lit(True))
    return met.withColumn("reason", F.when(is_move, "moved").when(gone, "moved_away")).drop("moved_at")


def second_only(second: DataFrame, first: DataFrame) -> DataFrame:
    """Holdings of the second exchange (security, first_symbol, pct) with ``reason``: the first exchange's filing wins.

    A security in the first's table goes (``dual_listed_left_out`` with a symbol there, else
    ``in_first_table_left_out``); without any security in that table a symbol alone is enough. Of those left,
    rows without a percentage are ``not_parsed_yet``.
    """
    held = first.where("security is not null").select(F.col("security").alias("f_security")).distinct().withColumn("there", F.lit(True))
    known = first.agg(F.coalesce(F.bool_or(F.col("security").isNotNull()), F.lit(False)).alias("any_there"))
    met = second.join(held, F.col("security") == F.col("f_security"), "left").crossJoin(F.broadcast(known))
    symbol = F.col("first_symbol").isNotNull()
    out = F.when(F.col("any_there"), F.coalesce("there", F.lit(False))).otherwise(symbol)
    reason = F.when(out & symbol, "dual_listed_left_out").when(out, "in_first_table_left_out").when(F.col("pct").isNull(), "not_parsed_yet")
    return met.withColumn("reason", reason).drop("f_security", "there", "any_there")


def of_both(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first exchange's rows and those of ``second`` (linked) that it lacks, with ``listed_on``; columns that one side lacks are null there."""
    own = first if "listed_on" in first.columns else first.withColumn("listed_on", F.lit("first"))
    return own.unionByName(second.where(~F.coalesce("on_first", F.lit(False))).drop("on_first", "first_event_id"), allowMissingColumns=True)
