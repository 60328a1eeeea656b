"""Insiders' trades beside the exchange's own deals: who is a promoter, sides of matched pairs, and sales placed with several buyers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.linkage import asof_join, exists_in_span
from tidewater.session import settled

# The domain's roles, and how far a buyer's price may be from the seller's.
GROUP_ROLES = ("promoter", "promoter_group")
INSIDER_ROLES = (*GROUP_ROLES, "director", "kmp")
PLACEMENT_GAP = 0.0005


def near_block(value: Column, relative: float) -> Column:
    """The logarithmic block of a positive value: values within ``relative`` of each other are in one block or in neighbours."""
    return F.floor(F.log(value) / F.log(F.lit((1 + relative) / (1 - relative))))


def marked_promoters(deals: DataFrame, members: DataFrame, filed: DataFrame) -> DataFrame:
    """Deals with ``client_is_promoter`` and ``client_promoter_basis`` (``promoter_group_list`` before ``pit_filing``, else null).

    ``deals``: security, client_id, client_alt_id (the name before a bracket) and any other columns.
    ``members``: security, member_id, member_alt_id of the latest list. ``filed``: security, person_id, role
    of filed trades. Ids are compared, never names alone; null ids are nobody. Ids of a security are one row
    before they meet the deals, so no deal is multiplied.
    """
    listed = members.select("security", F.explode(F.array_compact(F.array("member_id", "member_alt_id"))).alias("id")).where("security is not null").distinct()
    known = listed.withColumn("rank", F.lit(1)).unionByName(filed.where(F.col("role").isin(*GROUP_ROLES)).selectExpr("security", "person_id AS id", "2 AS rank").dropna())
    best = known.groupBy(F.col("security").alias("of"), "id").agg(F.min("rank").alias("by_id"))
    by_alt = listed.select(F.col("security").alias("alt_of"), F.col("id").alias("alt"), F.lit(1).alias("by_alt"))
    met = deals.join(best, (F.col("security") == F.col("of")) & (F.col("client_id") == F.col("id")), "left").drop("of", "id")
    met = met.join(by_alt, (F.col("security") == F.col("alt_of")) & (F.col("client_alt_id") == F.col("alt")), "left").drop("alt_of", "alt")
    rank = F.least("by_id", "by_alt")
    basis = F.when(rank == 1, "promoter_group_list").when(rank == 2, "pit_filing")
    return met.withColumns({"client_is_promoter": rank.isNotNull(), "client_promoter_basis": basis}).drop("by_id", "by_alt")


def paired_deals(deals: DataFrame) -> DataFrame:
    """(security, quantity, day, turn, buyer, seller, in_group): one row for each pair of which both sides are there.

    A pair is inside the group when all its clients are promoters; an unknown client is none.
    """
    side = lambda name: F.min(F.when(F.col("side") == name, F.struct("security", "quantity", "day", "client_name")))
    pairs = deals.where("pair is not null").groupBy("pair").agg(side("BUY").alias("b"), side("SELL").alias("s"), F.every(F.coalesce("client_is_promoter", F.lit(False))).alias("in_group"))
    return pairs.where("b is not null and s is not null").select("b.security", "b.quantity", "b.day", F.col("pair").alias("turn"), F.col("b.client_name").alias("buyer"), F.col("s.client_name").alias("seller"), "in_group")


def marked_pairs(trades: DataFrame, deals: DataFrame) -> DataFrame:
    """Trades with ``cross_with`` and ``group_transfer_by_deal``; a transfer's ``kind`` becomes ``inter_se`` and its ``is_market`` false.

    ``trades``: security, quantity, side, kind, role, day_from, day_to, is_market and any other columns;
    ``deals``: pair, security, quantity, day, side, client_name, client_is_promoter. An insider's market trade
    that is one side of a pair (same security and shares, its day within the trade's days) names the other
    side; of several pairs the last by day, then by number. A pair inside the group is a transfer for the
    promoters' trades that hold it, unless an officer's trade holds it too. A trade without a first day has its
    last day only; null keys match nothing. Both lookups are as-of lookups: no pairs of a hot key are made.
    """
    pairs = paired_deals(deals)
    keys = ["security", "quantity"]
    told = settled(trades.withColumn("held_from", F.coalesce("day_from", "day_to")), "told-trades")
    subject = F.coalesce((F.col("kind") == "market") & F.col("role").isin(*INSIDER_ROLES) & F.col("side").isin("BUY", "SELL") & F.col("security").isNotNull() & F.col("quantity").isNotNull() & (F.col("held_from") <= F.col("day_to")), F.lit(False))
    subjects = told.where(subject)
    promoter = F.col("role").isin(*GROUP_ROLES)
    inside = pairs.where("in_group").select(*keys, "day").distinct()
    free = exists_in_span(inside, subjects.where(~promoter), keys, "day", "held_from", "day_to").where("not in_span").select(*keys, "day", F.lit(True).alias("inside"))
    asked = asof_join(subjects.select(*keys, "day_to").distinct(), pairs, keys, "day_to", "day", ["turn", "buyer", "seller"]).withColumnRenamed("matched_time", "pair_day")
    known = asof_join(asked, free, keys, "day_to", "day", ["inside"]).withColumnRenamed("matched_time", "inside_day")
    named = subjects.join(known, [*keys, "day_to"])
    other = F.when(F.col("pair_day") >= F.col("held_from"), F.when(F.col("side") == "SELL", F.col("buyer")).otherwise(F.col("seller")))
    is_transfer = promoter & F.coalesce(F.col("inside_day") >= F.col("held_from"), F.lit(False))
    moved = named.withColumns({"cross_with": other, "group_transfer_by_deal": is_transfer}).drop("turn", "buyer", "seller", "pair_day", "inside", "inside_day")
    moved = moved.withColumns({"kind": F.when(F.col("group_transfer_by_deal"), "inter_se").otherwise(F.col("kind")), "is_market": F.col("is_market") & ~F.col("group_transfer_by_deal")})
    rest = told.where(~subject).withColumns({"cross_with": F.lit(None).cast("string"), "group_transfer_by_deal": F.lit(False)})
    return moved.unionByName(rest).drop("held_from")


def _sales_and_buys(deals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Promoters' legs of sale, and the legs that others bought by security, day, price (``paid``) and name with their ``block``."""
    sound = deals.dropna(subset=["security", "day", "quantity", "price", "side"]).where("price > 0")
    promoter = F.coalesce("client_is_promoter", F.lit(False))
    buys = sound.where((F.col("side") == "BUY") & ~promoter).groupBy("security", "day", F.col("price").alias("paid"), "client_name").agg(F.count("*").alias("legs"))
    return sound.where((F.col("side") == "SELL") & promoter), buys.withColumn("block", near_block(F.col("paid"), PLACEMENT_GAP))


def _reached(prices: DataFrame, buys: DataFrame) -> DataFrame:
    """``prices`` (security, day, price) beside the rows of ``buys`` near them: prices meet in logarithmic blocks, own and beside, and are then held to ``PLACEMENT_GAP`` of the seller's."""
    block = near_block(F.col("price"), PLACEMENT_GAP)
    near = F.abs(F.col("paid") - F.col("price")) <= F.lit(PLACEMENT_GAP) * F.col("price")
    return prices.withColumn("block", F.explode(F.array(block - 1, block, block + 1))).join(buys, ["security", "day", "block"]).where(near)


def placed_sales(deals: DataFrame) -> DataFrame:
    """(security, quantity, day, turn, price): promoters' legs of sale that two or more legs of others bought that day at that price. Legs are one row a price before they meet."""
    sales, buys = _sales_and_buys(deals)
    legs = buys.groupBy("security", "day", "paid", "block").agg(F.sum("legs").alias("legs"))
    placed = _reached(sales.select("security", "day", "price").distinct(), legs).groupBy("security", "day", "price").agg(F.sum("legs").alias("legs")).where("legs >= 2")
    return sales.join(placed, ["security", "day", "price"]).select("security", "quantity", "day", F.col("deal_id").alias("turn"), "price")


def placement_names(deals: DataFrame, prices: DataFrame) -> DataFrame:
    """(security, day, price, placement_buyers): who bought at ``prices`` (security, day, price), once each, in order of their letters: as many as one company's buyers of a day at one price."""
    name = F.when(F.col("client_name") != "", F.col("client_name"))
    return _reached(prices, _sales_and_buys(deals)[1]).groupBy("security", "day", "price").agg(F.array_sort(F.collect_set(name)).alias("placement_buyers"))


def marked_placements(trades: DataFrame, deals: DataFrame) -> DataFrame:
    """Trades with ``placement_buyers``: of a promoter's market sale without a known other side that is one of ``placed_sales`` (security, shares, day within the trade's days), the last one's buyers.

    A sale is found by its price; names are gathered for the prices that some trade found, and no lookup carries them.
    """
    told = trades.withColumn("held_from", F.coalesce("day_from", "day_to"))
    subject = F.coalesce((F.col("kind") == "market") & F.col("role").isin(*GROUP_ROLES) & (F.col("side") == "SELL") & F.col("cross_with").isNull() & F.col("security").isNotNull() & F.col("quantity").isNotNull() & (F.col("held_from") <= F.col("day_to")), F.lit(False))
    keys = ["security", "quantity"]
    known = asof_join(told.where(subject).select(*keys, "day_to").distinct(), placed_sales(deals).withColumnsRenamed({"turn": "placed_turn", "price": "placed_price"}), keys, "day_to", "day", ["placed_turn", "placed_price"])
    within = F.col("matched_time") >= F.col("held_from")
    found = told.where(subject).join(known, [*keys, "day_to"]).withColumns({"placed_day": F.when(within, F.col("matched_time")), "placed_price": F.when(within, F.col("placed_price"))}).drop("placed_turn", "matched_time")
    found = settled(found, "placed-trades")
    at = {"day": "placed_day", "price": "placed_price"}
    prices = found.select("security", *(F.col(c).alias(k) for k, c in at.items())).dropna().distinct()
    named = found.join(placement_names(deals, prices).withColumnsRenamed(at), ["security", *at.values()], "left").drop(*at.values())
    return named.unionByName(told.where(~subject).withColumn("placement_buyers", F.lit(None).cast("array<string>"))).drop("held_from")


def insider_transfers(trades: DataFrame, deals: DataFrame) -> DataFrame:
    """Trades marked by the exchange's pairs, then by placements; every row stays once. Columns as the two steps name them; ``deals`` also has deal_id and price. Trades and the first step are written once, as what follows reads them more than once."""
    return marked_placements(settled(marked_pairs(trades, deals), "paired-trades"), deals)
