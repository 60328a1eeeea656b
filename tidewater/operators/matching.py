"""One-to-one matching in row order, as rounds of offers and acceptances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranking import AT, STRETCH, counted_on, numbered_within, sorted_stretches
from tidewater.session import settled


def _runs(right: DataFrame, keys: list[str], attributes: list[str], order: list[Column]) -> DataFrame:
    """``right`` numbered by keys and ``order`` as ``n``, with ``run``: the number of the first row of its run of equal keys and attributes.

    Stretches are looked through one by one; what a run that goes on from earlier stretches began with
    comes from a table of one row a stretch.
    """
    placed = counted_on(sorted_stretches(right, [*keys, *order]), "n").withColumn("told", F.struct(*keys, *attributes))
    inside, stretches = Window.partitionBy(STRETCH).orderBy(AT), Window.orderBy("s")
    lasts = placed.groupBy(F.col(STRETCH).alias("s")).agg(F.max_by("told", AT).alias("last")).select("s", F.lag("last").over(stretches).alias("ahead"))
    before = F.when(F.col(AT) == 0, F.col("ahead")).otherwise(F.lag("told").over(inside))
    opened = placed.join(F.broadcast(lasts), F.col(STRETCH) == F.col("s")).withColumn("opens", F.when(~F.col("told").eqNullSafe(before), F.col("n"))).drop("s", "ahead", "told")
    carried = opened.groupBy(F.col(STRETCH).alias("s")).agg(F.max("opens").alias("open")).select("s", F.max("open").over(stretches.rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    found = opened.join(F.broadcast(carried), F.col(STRETCH) == F.col("s"))
    return found.withColumn("run", F.coalesce(F.max("opens").over(inside), "open")).drop("s", "open", "opens", STRETCH, AT)


def matched_in_order(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, left_order: list[str], right_order: list[str],
    left_attributes: list[str], right_attributes: list[str], compatible: Column, blocks: tuple[str, str] | None = None,
) -> DataFrame:
    """(left_id, right_id): for each left row in order the first right row of its key that is free and compatible with it.

    This is what a loop over the left rows gives. Each left row offers itself to its first compatible right
    row; a right row keeps the earliest left one that comes and turns others away, who go on to their next.
    As all right rows prefer earlier left ones, this ends in the loop's matching. Rows do not deal with
    each other one by one: right rows that follow each other with the same attributes are a run, that
    keeps as many offers as it has rows, and left rows with the same attributes see the same runs. So a
    key with very many equal rows is settled in one round, and its rows are numbered over stretches.

    ``compatible`` reads ``l_<name>`` and ``r_<name>`` of the attributes. ``blocks``: an array column of
    the left and a column of the right; only rows whose value is in the array meet (a tolerance then
    needs no pairs of all of a key). Rows with a null key or without compatible rows get nothing. Ids are
    unique, and the orders total, for the result to be the loop's; an empty side gives no pairs.
    """
    sides = list(keys)
    none = left.select(F.col(left_id), F.lit(None).cast(right.schema[right_id].dataType).alias(right_id)).where(F.lit(False))
    turns = [f"o_{c}" for c in left_order]
    l_attributes = [f"l_{c}" for c in left_attributes] + (["l__in"] if blocks else [])
    r_attributes = [f"r_{c}" for c in right_attributes] + (["r__of"] if blocks else [])
    lefts = left.select(*sides, F.col(left_id).alias("left_id"), *_named(left_attributes, "l_"), *([F.col(blocks[0]).alias("l__in")] if blocks else []), *_named(left_order, "o_"))
    lefts = lefts.dropna(subset=sides).withColumn("class", F.xxhash64(*sides, *l_attributes))
    rights = right.select(*sides, F.col(right_id).alias("right_id"), *_named(right_attributes, "r_"), *([F.col(blocks[1]).alias("r__of")] if blocks else []), *_named(right_order, "o_"))
    rights = rights.dropna(subset=sides)
    lefts = settled(_met(lefts, rights, sides), "match-lefts")
    if lefts.isEmpty():
        return none
    rights = settled(_runs(_met(rights, lefts, sides), sides, r_attributes, _in_order(right_order)).select("n", "run", "right_id", *sides, *r_attributes), "match-rights")
    runs = rights.groupBy("run", *sides, *r_attributes).agg(F.count("*").alias("room"))
    classes = lefts.select("class", *sides, *l_attributes).distinct()
    met = classes.withColumn("r__of", F.explode("l__in")).join(runs, [*sides, "r__of"]) if blocks else classes.join(runs, sides)
    after = F.lead("run").over(Window.partitionBy("class").orderBy("run"))
    choices = settled(met.where(compatible).select("class", "run", "room").distinct().withColumn("next", after), "match-choices")
    if choices.isEmpty():
        return none
    first = choices.groupBy("class").agg(F.min("run").alias("run"))
    offers = lefts.select("left_id", "class", *turns).join(first, "class")
    room = choices.groupBy("run").agg(F.any_value("room").alias("room"))
    while True:
        crowded = offers.groupBy("run").agg(F.count("*").alias("n")).join(room, "run").where("n > room").select("run", "room")
        away = settled(_placed(offers.join(crowded, "run"), left_order).where(F.col("place") > F.col("room")), "match-away") if not crowded.isEmpty() else crowded
        if away.isEmpty():
            break
        moved = away.join(choices.select("class", "run", "next"), ["class", "run"]).where("next is not null").select("left_id", "class", *turns, F.col("next").alias("run"))
        offers = settled(offers.join(away.select("left_id"), "left_id", "left_anti").unionByName(moved), "match-offers")
    taken = _placed(offers, left_order)
    return taken.select("left_id", (F.col("run") + F.col("place") - 1).alias("n")).join(rights.select("n", "right_id"), "n").select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id))


def _met(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys ``other`` may have too, told by a hash: the others take no part."""
    return df.join(other.select(F.xxhash64(*keys).alias("of")).distinct(), F.xxhash64(*keys) == F.col("of"), "left_semi")


def _placed(offers: DataFrame, left_order: list[str]) -> DataFrame:
    """Offers with their place in their run, by the left order."""
    return numbered_within(offers, ["run"], _in_order(left_order))


def _named(columns: list[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in columns]


def _in_order(order: list[str]) -> list[Column]:
    """Nulls last."""
    return [F.col(f"o_{c}").asc_nulls_last() for c in order]
