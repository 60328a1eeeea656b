"""Events of a company's capital: promoters' deals without a filing, issues to promoters, buybacks and raises, as rows of ``signals.EVENT``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.signals import _event
from tidewater.operators.trades import bought, sold

# The domain's window and floors.
DAYS, LEAST_PCT, ISSUE_PREMIUM, BUYBACK_PREMIUM = 90, 0.05, 0.0, 10.0
RAISE_AMOUNT, RAISE_DILUTION, MOST_DILUTION = 100e7, 2.0, 0.5


def _in_days(day: str, ref: Column, days: int) -> Column:
    """Within ``days`` up to the day after ``ref``; null is outside."""
    return F.coalesce((F.col(day) <= F.date_add(ref, 1)) & (F.col(day) > F.date_sub(ref, days)), F.lit(False))


def latest_shares(holdings: DataFrame) -> DataFrame:
    """(security, total): shares of the latest quarter that states them; of several the most."""
    known = holdings.dropna(subset=["security", "total_shares"])
    return known.groupBy("security").agg(F.max_by("total_shares", F.struct("quarter_end", "total_shares")).alias("total"))


def promoter_deal_events(deals: DataFrame, filed: DataFrame, shares: DataFrame, ref: Column, days: int = DAYS, least_pct: float = LEAST_PCT) -> DataFrame:
    """Promoters' net deals (security, side, quantity, value, day; primary legs of promoters) where no promoter's market trade (security, day) is filed in the window: then the deal is the only record.

    The share is of ``shares`` (security, total); without a total there is no event. Nothing net is a sale of nothing, and below the floor.
    """
    recent = deals.where((F.col("day") <= ref) & (F.col("day") > F.date_sub(ref, days)) & F.col("security").isNotNull())
    unfiled = recent.join(filed.where(_in_days("day", ref, days)).select("security").distinct(), "security", "left_anti")
    net = unfiled.groupBy("security").agg(F.sum(bought("side", "quantity") - sold("side", "quantity")).alias("net"), F.sum(bought("side", "value") - sold("side", "value")).alias("worth"), F.max("day").alias("last"))
    pct = F.abs("net") / F.col("total") * 100
    hit = net.join(shares.where("total > 0"), "security").where(pct >= least_pct)
    up = F.col("net") > 0
    return _event(hit, "security", F.when(up, "look").otherwise("warn"), F.when(up, "promoter_deal_buy").otherwise("promoter_deal_sale"), pct, F.abs("worth"), F.col("last"))


def promoter_parts(allottees: DataFrame) -> DataFrame:
    """(app_id, part, members): the share of an application's named securities that goes to the promoter group; none without positive numbers."""
    mine = F.coalesce("in_promoter_group", F.lit(False))
    sums = allottees.where("app_id is not null").groupBy("app_id").agg(F.sum(F.when(mine, F.col("securities")).otherwise(0)).alias("mine"), F.sum("securities").alias("named"), F.count_if(mine).alias("members"), F.max("securities").alias("most"))
    return sums.where("most > 0 AND named > 0").select("app_id", (F.col("mine") / F.col("named")).alias("part"), "members")


def issue_events(issues: DataFrame, parts: DataFrame, shares: DataFrame, ref: Column, days: int = DAYS) -> DataFrame:
    """Preferential issues (app_id, security, category, vs_market, allotted, proposed, amount, day) to promoters at or above the price now (look) or below it (warn).

    A mixed issue counts with its promoters' part, and not at all when its named allottees hold none; one
    without a list counts whole. Without a price, a security or a day in the window there is no event.
    """
    known = issues.where(F.col("category").isin("PROMOTER", "MIXED") & F.col("vs_market").isNotNull() & F.col("security").isNotNull() & _in_days("day", ref, days))
    split = known.join(parts, "app_id", "left").join(shares, "security", "left")
    mixed = F.col("category") == "MIXED"
    counted = split.where(~(mixed & F.coalesce(F.col("members") == 0, F.lit(False))))
    whole = F.coalesce(F.coalesce("allotted", "proposed") / F.when(F.col("total") > 0, F.col("total")) * 100, F.lit(0.0))
    pct = whole * F.when(mixed, F.coalesce("part", F.lit(1.0))).otherwise(1.0)
    up = F.col("vs_market") >= ISSUE_PREMIUM
    return _event(counted, "security", F.when(up, "look").otherwise("warn"), F.when(up, "promoters_pay_up").otherwise("cheap_shares_to_promoters"), pct, F.col("amount"), F.col("day"))


def buyback_events(buybacks: DataFrame, shares: DataFrame, ref: Column, days: int = DAYS) -> DataFrame:
    """Tender buybacks (security, route, vs_market, sought, offer_value, opens, record_day) well above the price now that opened in the window or are still to open."""
    day = F.coalesce("opens", "record_day")
    hit = buybacks.where((F.col("route") == "tender") & (F.col("vs_market") >= BUYBACK_PREMIUM) & (day > F.date_sub(ref, days)))
    sized = hit.join(shares, "security", "left")
    return _event(sized, "security", F.lit("look"), F.lit("buyback_at_premium"), F.coalesce(F.col("sought") / F.when(F.col("total") > 0, F.col("total")) * 100, F.lit(0.0)), F.col("offer_value"), day)


def raise_events(raises: DataFrame, shares: DataFrame, ref: Column, days: int = DAYS) -> DataFrame:
    """Capital raised (security, source, status, category, allotted_on, posted_on, amount, allotted): one event a raise, by its ``source`` (preferential, qip, rights).

    Allotted or listed only, preferential ones to others than promoters alone. Shown from ``RAISE_AMOUNT`` or
    ``RAISE_DILUTION`` percent of the shares; shares of half the company or more are an error and no dilution.
    """
    day = F.coalesce("allotted_on", "posted_on")
    others = (F.col("source") != "preferential") | F.coalesce(F.col("category").isin("NON_PROMOTER", "MIXED"), F.lit(False))
    done = raises.where((F.col("status") == "Allotted or listed") & others & F.col("security").isNotNull()).withColumn("day", day).where(_in_days("day", ref, days)).join(shares, "security", "left")
    diluted = F.when((F.col("allotted") > 0) & (F.col("total") > 0) & (F.col("allotted") < F.col("total") * MOST_DILUTION), F.col("allotted") / F.col("total") * 100)
    amount = F.when(F.col("amount") > 0, F.col("amount"))
    large = F.coalesce(amount >= RAISE_AMOUNT, F.lit(False)) | F.coalesce(diluted >= RAISE_DILUTION, F.lit(False))
    return _event(done.where(large), "security", F.lit("look"), F.concat(F.lit("raise_"), F.col("source")), F.coalesce(diluted, F.lit(0.0)), amount, F.col("day"))
