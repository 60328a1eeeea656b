"""Cleaning of bulk and block deals from end to end: printed rows to legs, each removal with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import trades
from tidewater.session import settled
from tidewater.spec import LIMITS

LEG = ["exchange", "security_key", "client", "day", "side"]
CLIENT_DAY = ["security_key", "client", "day"]
ROW_REASONS = ["intraday_round_trip", "same_deal_in_older_form", "same_trade_in_both_feeds", "block_legs_inside_bulk_total"]
LEG_REASONS = ["intraday_round_trip_across_exchanges", "same_day_both_sides_netted"]

#: Prices of a matched pair differ by this share at most; a pair is in the same logarithmic block of PAIR_BASE or in one beside it.
PAIR_GAP, PAIR_BASE = 0.0005, 1.001


def _live() -> Column:
    return F.col("reason").isNull()


def _because(df: DataFrame, gone: Column, reason: str) -> DataFrame:
    return df.withColumn("reason", F.when(_live() & F.coalesce(gone, F.lit(False)), F.lit(reason)).otherwise(F.col("reason")))


def _totals(df: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """``df`` with sums over the live rows of its keys (null keys are equal), from an aggregate that tasks begin."""
    keyed = df.withColumn("key", F.struct(*keys))
    found = keyed.where(_live()).groupBy(F.col("key").alias("of")).agg(*(c.alias(n) for n, c in sums.items()))
    return keyed.join(found, F.col("key") == F.col("of"), "left").drop("key", "of")


def deal_rows(deals: DataFrame) -> DataFrame:
    """All printed rows with ``security_key``, ``feeds`` and ``reason`` (null: kept).

    Columns read: row_id (unique), exchange, feed (block or bulk), from_csv, security, symbol, client, side,
    quantity, price, day, round_trip.

    In this order a row goes that is marked as a round trip; that an older form of the feed repeats
    (``same_deal_in_older_form``: rows of one form are never compared); that the other feed repeats (the
    block's copy stays, ``feeds`` names both); and that a client's total of the day holds: where rows of
    both feeds are left on one side, the feed with the larger total stands for the day, bulk if they are
    equal (``block_legs_inside_bulk_total``).
    """
    key = F.coalesce("security", F.concat(F.col("exchange"), F.lit(":"), F.col("symbol")))
    df = deals.withColumns({"security_key": key, "reason": F.lit(None).cast("string"), "from_csv": F.coalesce("from_csv", F.lit(False))})
    df = _because(df, F.col("round_trip"), "intraday_round_trip")
    same = F.struct("exchange", "feed", "day", "symbol", "client", "side", "quantity", F.round("price", 2).alias("price"))
    told = df.withColumn("key", same)
    fresh = told.where(_live() & F.col("from_csv")).select(F.col("key").alias("of")).distinct().withColumn("in_csv", F.lit(True))
    df = _because(told.join(fresh, F.col("key") == F.col("of"), "left"), ~F.col("from_csv") & F.col("in_csv"), "same_deal_in_older_form").drop("key", "of", "in_csv")
    df = settled(df, "deal-rows")
    # numbers and flags alone, which tasks sum by hash: strings, structs and lists would be sorted
    least = {f"in_{name}": F.min(F.when(c, F.col("row_id"))) for name, c in (("none", F.col("feed").isNull()), ("block", F.col("feed") == "block"), ("bulk", F.col("feed") == "bulk"))}
    df = _totals(df, [*LEG, "quantity", "price"], **least)
    told_by = F.when(F.coalesce(*least).isNotNull(), F.array_compact(F.array(*(F.when(F.col(f"in_{name}").isNotNull(), name) for name in ("block", "bulk")))))
    df = _because(df.withColumn("feeds", told_by), F.col("row_id") != F.coalesce(*least), "same_trade_in_both_feeds").drop(*least)
    bulk, block = F.array_contains("feeds", "bulk"), F.array_contains("feeds", "block")
    held = lambda c: F.sum(F.when(c, F.col("quantity")).otherwise(0.0))
    df = _totals(df, LEG, bulk_total=held(bulk), block_total=held(block), bulk_alone=F.count_if(bulk & ~block), block_alone=F.count_if(block & ~bulk))
    mixed = F.coalesce((F.col("bulk_alone") > 0) & (F.col("block_alone") > 0), F.lit(False))
    larger = F.col("bulk_total") >= F.col("block_total")
    inside = mixed & ((block & ~bulk & larger) | (bulk & ~block & ~larger))
    both = F.array(F.lit("block"), F.lit("bulk"))
    return _because(df, inside, "block_legs_inside_bulk_total").withColumn("feeds", F.when(mixed, both).otherwise(F.col("feeds"))).drop("bulk_total", "block_total", "bulk_alone", "block_alone")


def maker_quarters(legs: DataFrame) -> DataFrame:
    """(client, quarter) of market makers: many legs, about as much bought as sold, in the 91 days to the quarter's end, or to the latest deal in the quarter that still runs."""
    quarter = F.trunc("day", "quarter")
    latest = legs.agg(F.max("day").alias("latest"))
    ends = legs.where("day is not null").select(quarter.alias("quarter")).distinct().crossJoin(latest).select("quarter", F.least(F.date_sub(F.add_months("quarter", 3), 1), "latest").alias("period_end"))
    found = trades.market_makers(legs.where("client is not null and day is not null"), "client", "day", "side", "value", ends.select("period_end").distinct())
    return found.join(ends, "period_end").select("client", "quarter").distinct()


def deal_legs(rows: DataFrame) -> DataFrame:
    """Kept rows rolled up to legs, one a client, security, day and side on an exchange, with what marks them and ``reason`` (null: kept).

    A client that bought and sold about the same in a day on all exchanges together changed nothing, and
    all its legs go (``intraday_round_trip_across_exchanges``). One that did both in unequal amounts
    changed its holding by the difference: the smaller side's legs go (``same_day_both_sides_netted``), the
    larger side's are scaled to it, and keep the gross shares of both. Market makers (by quarter) are
    marked, and keep their gross legs. ``pair_leg`` is the other side of a matched pair: one buyer and one
    seller of the same shares at the same price, no other in question. ``twin`` says that the client has a
    leg of the same size on the other exchange.
    """
    kept = rows.where(_live())
    legs = kept.groupBy(*LEG).agg(
        F.min("row_id").alias("leg_id"), F.max(F.col("security").isNotNull()).alias("named"), F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("value"), F.count("*").alias("trades"), *(F.max(F.array_contains("feeds", f)).alias(f) for f in ("block", "bulk"))
    )
    # a known security is its own key; numbers and flags alone are summed by hash
    feeds = F.array_compact(F.array(*(F.when(F.col(f), f) for f in ("block", "bulk"))))
    legs = legs.select(*LEG, "leg_id", F.when(F.col("named"), F.col("security_key")).alias("security"), "quantity", "value", "trades", feeds.alias("feeds"))
    legs = settled(legs.withColumns({"price": F.when(F.col("quantity") > 0, F.col("value") / F.col("quantity")), "quarter": F.trunc("day", "quarter"), "reason": F.lit(None).cast("string")}), "deal-legs")
    makers = maker_quarters(legs).withColumn("is_maker", F.lit(True))
    legs = legs.join(makers, ["client", "quarter"], "left").withColumn("is_maker", F.coalesce("is_maker", F.lit(False))).drop("quarter")
    sized = F.when(F.col("quantity") > 0, F.col("quantity"))
    sides = {"bought": F.sum(F.when(F.col("side") == "BUY", sized)), "sold": F.sum(F.when(F.col("side") == "SELL", sized))}
    known = F.col("client").isNotNull() & F.col("day").isNotNull() & F.col("security_key").isNotNull()
    both = known & F.coalesce((F.col("bought") > 0) & (F.col("sold") > 0), F.lit(False))
    legs = _totals(legs, CLIENT_DAY, **sides)
    trip = both & (F.abs(F.col("bought") - F.col("sold")) <= LIMITS.round_trip_tolerance * F.greatest("bought", "sold"))
    legs = _because(legs, trip, "intraday_round_trip_across_exchanges")
    two_way = both & _live() & ~F.col("is_maker") & F.col("side").isNotNull()
    larger = F.when(F.col("bought") > F.col("sold"), "BUY").otherwise("SELL")
    legs = legs.withColumns({"nets": two_way & (F.col("side") == larger), "goes": two_way & (F.col("side") != larger)})
    share = F.when(F.col("nets"), F.abs(F.col("bought") - F.col("sold")) / F.greatest("bought", "sold")).otherwise(1.0)
    legs = _because(legs, F.col("goes"), "same_day_both_sides_netted").withColumns({"quantity": F.col("quantity") * share, "value": F.col("value") * share, "two_way_bought": F.when(F.col("nets"), F.col("bought")), "two_way_sold": F.when(F.col("nets"), F.col("sold"))})
    legs = settled(legs.drop("bought", "sold", "nets", "goes"), "deal-legs")
    pairs = matched_pairs(legs.where(_live()))
    other = pairs.unionByName(pairs.select(F.col("pair_leg").alias("leg_id"), F.col("leg_id").alias("pair_leg")))
    twins = _totals(legs, ["security", "client", "day", "side", "quantity"], venues=F.count_distinct("exchange"))
    whole = F.col("security").isNotNull() & known & F.col("side").isNotNull() & F.col("quantity").isNotNull()
    return twins.withColumn("twin", _live() & whole & F.coalesce(F.col("venues") > 1, F.lit(False))).drop("venues").join(other, "leg_id", "left").withColumn("flags", deal_flags())


def matched_pairs(legs: DataFrame) -> DataFrame:
    """(leg_id, pair_leg): a buy and a sell of different clients, the only ones for each other with the same exchange, security, day and shares and about the same price.

    Legs meet in logarithmic blocks of the price, own and beside. Of legs with one price three stand for
    all: three are enough to tell that a leg has more than one partner.
    """
    keys = ["exchange", "security_key", "day", "quantity"]
    sound = legs.dropna(subset=[*keys, "side", "price", "client"]).where("price > 0")
    few = sound.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "side", "price").orderBy("leg_id"))).where("at <= 3")
    block = F.floor(F.log("price") / F.log(F.lit(PAIR_BASE)))
    buys = few.where("side = 'BUY'").select(*keys, "leg_id", F.col("client").alias("buyer"), F.col("price").alias("paid"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    sells = few.where("side = 'SELL'").select(*keys, F.col("leg_id").alias("pair_leg"), F.col("client").alias("seller"), F.col("price").alias("taken"), block.alias("block"))
    met = buys.join(sells, [*keys, "block"]).where((F.col("buyer") != F.col("seller")) & (F.abs(F.col("paid") - F.col("taken")) <= PAIR_GAP * F.col("paid"))).select("leg_id", "pair_leg")
    alone = [met.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c) for c in ("leg_id", "pair_leg")]
    return met.join(alone[0], "leg_id").join(alone[1], "pair_leg").select("leg_id", "pair_leg")


def deal_flags() -> Column:
    """What holds a leg back until it is looked at; removed legs have none."""
    flags = {
        "unmatched_security": F.col("security").isNull(),
        "missing_price_or_quantity": ~(F.coalesce(F.col("price") > 0, F.lit(False)) & F.coalesce(F.col("quantity") > 0, F.lit(False))),
        "missing_side": F.col("side").isNull(),
    }
    return F.array_compact(F.array(*(F.when(_live() & F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags.items())))


def first_counterparties(legs: DataFrame, most: int = 5) -> DataFrame:
    """(exchange, security_key, day, side, counterparties): the clients on the other side that day, real ones first, then by value; at most ``most`` of them."""
    place = Window.partitionBy("exchange", "security_key", "day", "side").orderBy("is_maker", F.desc("value"), "client")
    first = legs.where(_live() & F.col("client").isNotNull() & F.col("side").isin("BUY", "SELL")).withColumn("at", F.row_number().over(place)).where(F.col("at") <= most)
    listed = first.groupBy("exchange", "security_key", "day", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "client"))), lambda x: x["client"].cast("string")), "; ").alias("counterparties"))
    return listed.withColumn("side", F.when(F.col("side") == "BUY", "SELL").otherwise("BUY"))
