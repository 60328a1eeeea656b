"""Signals: event builders, the two lists of a day, boards, and floors. An event is one row of one kind on one security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranking import numbered_within
from tidewater.operators.trades import bought, in_window, sold
from tidewater.session import dealt

EVENT = ["security", "list", "kind", "pct", "value", "last"]


def _event(df: DataFrame, security: str, list_: Column, kind: Column, pct: Column, value: Column, last: Column) -> DataFrame:
    return df.select(F.col(security).alias("security"), list_.alias("list"), kind.alias("kind"), pct.cast("double").alias("pct"), value.cast("double").alias("value"), last.alias("last"))


def idea_kinds(decisions: DataFrame, group: Column, officer: Column, steady: Column, clusters: DataFrame, spotlights: DataFrame) -> DataFrame:
    """One row a security of qualified buy decisions: sums, makers, last day and ``kinds``, the reasons in a fixed order.

    ``decisions``: (security, person, pct, value, quantity, last_day). ``clusters`` and ``spotlights``: (security).
    """
    marks = clusters.select("security").distinct().withColumn("in_cluster", F.lit(True)).join(spotlights.select("security").distinct().withColumn("in_spot", F.lit(True)), "security", "full")
    grouped = decisions.groupBy("security").agg(
        F.bool_or(group).alias("by_group"), F.bool_or(~group & officer).alias("by_officer"), F.bool_or(steady).alias("steady"), F.sum("pct").alias("pct"),
        F.sum("value").alias("value"), F.sum("quantity").alias("quantity"), F.count("*").alias("makers"), F.max("last_day").alias("last"), F.max_by("person", F.struct("pct", -F.col("person"))).alias("lead"),
    )
    kinds = F.array_compact(F.array(
        F.when(F.col("by_group"), "group_buying"), F.when(F.col("by_officer"), "officer_buying"), F.when(F.col("in_cluster"), "cluster"), F.when(F.col("in_spot"), "spotlight"), F.when(F.col("steady"), "steady"),
    ))
    return grouped.join(marks, "security", "left").select("security", "lead", "makers", "pct", "value", F.try_divide("value", "quantity").alias("avg_price"), "last", kinds.alias("kinds"))


def warnings(decisions: DataFrame, group: Column, qualified: Column, big: float) -> DataFrame:
    """One row a security of sell decisions: a group's past the usual floors, an officer's only when big."""
    own = decisions.where((group & qualified) | (~group & (F.col("value") >= big)))
    out = own.groupBy("security").agg(F.bool_or(group).alias("by_group"), F.sum("pct").alias("pct"), F.sum("value").alias("value"), F.count("*").alias("makers"), F.max("last_day").alias("last"))
    return out.withColumn("kind", F.when(F.col("by_group"), "group_selling").otherwise("officer_selling")).drop("by_group")


def insider_events(look: DataFrame, warn: DataFrame) -> DataFrame:
    """Ideas, one event a kind, and warnings, as events."""
    a = look.withColumn("kind", F.explode("kinds"))
    up = _event(a, "security", F.lit("look"), F.col("kind"), F.col("pct"), F.col("value"), F.col("last"))
    return up.unionByName(_event(warn, "security", F.lit("warn"), F.col("kind"), F.col("pct"), F.col("value"), F.col("last")))


def stake_events(stakes: DataFrame, change: float = 2.0, line: float = 5.0) -> DataFrame:
    """Disclosed stakes (security, holder, pct_bought, pct_sold, pct_after, day): in at ``change`` or more or up through ``line``; out likewise.

    A disclosure that repeats (all but its day) counts once, at its last day.
    """
    once = stakes.groupBy("security", "holder", "pct_bought", "pct_sold", "pct_after").agg(F.max("day").alias("day"))
    b, s, after = F.col("pct_bought"), F.col("pct_sold"), F.col("pct_after")
    rises = F.coalesce((b > 0) & ((b >= change) | ((after >= line) & (after - b < line))), F.lit(False))
    falls = ~rises & F.coalesce((s > 0) & ((s >= change) | ((after < line) & (after + s >= line))), F.lit(False))
    hit = once.where(rises | falls)
    return _event(hit, "security", F.when(rises, "look").otherwise("warn"), F.when(rises, "big_investor_in").otherwise("big_investor_out"), F.when(rises, b).otherwise(s), F.lit(None), F.col("day"))


def flow_events(deals: DataFrame, size: DataFrame, kinds: tuple[str, str], least_pct: float) -> DataFrame:
    """Net deals (security, side, value, day) against the company's ``size`` (security, market_cap): events at ``least_pct`` percent or more, either way."""
    net = deals.groupBy("security").agg(F.sum(bought("side", "value") - sold("side", "value")).alias("net"), F.max("day").alias("last"))
    sized = net.join(size, "security").withColumn("pct", F.when(F.col("market_cap") > 0, F.col("net") / F.col("market_cap") * 100)).where(F.abs("pct") >= least_pct)
    up = F.col("net") > 0
    return _event(sized, "security", F.when(up, "look").otherwise("warn"), F.when(up, kinds[0]).otherwise(kinds[1]), F.abs("pct"), F.abs("net"), F.col("last"))


def pledge_events(pledges: DataFrame, shares: DataFrame) -> DataFrame:
    """Pledges net by security: (security, person, quantity, kind create or revoke, held, day) against ``shares`` (security, total).

    A person's net is held within what they hold; shares released and pledged again are no new pledge.
    """
    step = F.when(F.col("kind") == "create", F.col("quantity")).otherwise(-F.col("quantity"))
    per = pledges.groupBy("security", "person").agg(F.sum(step).alias("q"), F.max("held").alias("held"), F.max("day").alias("day"))
    held = F.coalesce("held", F.abs("q"))
    net = per.withColumn("q", F.greatest(F.least("q", held), -held)).groupBy("security").agg(F.sum("q").alias("net"), F.max("day").alias("last")).where("net <> 0").join(shares, "security")
    up = F.col("net") > 0
    return _event(net, "security", F.when(up, "warn").otherwise("look"), F.when(up, "pledge_created").otherwise("pledge_released"), F.when(F.col("total") > 0, F.abs("net") / F.col("total") * 100), F.lit(None), F.col("last"))


def holder_events(holders: DataFrame, ref: Column, least_points: float = 1.0, least_value: float = 10e7, most_days: int = 120) -> DataFrame:
    """Latest holdings (security, pct, change, day, market_cap): a move of enough points, worth enough, in a recent quarter."""
    age = F.datediff(ref, "day")
    hit = holders.where((F.abs("change") >= least_points) & age.between(0, most_days) & (F.abs("change") / 100 * F.col("market_cap") >= least_value))
    up = F.col("change") > 0
    return _event(hit, "security", F.when(up, "look").otherwise("warn"), F.when(up, "holders_adding").otherwise("holders_trimming"), F.abs("change"), F.lit(None), F.col("day"))


def today(events: DataFrame, groups: dict[str, list[tuple[str, list[str]]]], big: float, most_lifted: int = 3) -> DataFrame:
    """One row a security and list: led by its largest event in its first group, with all its kinds, and ``place`` in the list.

    ``groups``: per list, named groups of kinds in their order. Rows worth ``big`` or more go first in their
    group by value, at most ``most_lifted`` of them; the rest go by share of the company, then the latest.
    Lifted rows are a top-k of each group, and places are counted over a range sort, so that a group of very
    many securities is not ranked in one task.
    """
    order, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for list_, named in groups.items():
        for i, (group, members) in enumerate(named):
            inside = (F.col("list") == list_) & F.col("kind").isin(members)
            order, name = F.when(inside, F.lit(i)).otherwise(order), F.when(inside, F.lit(group)).otherwise(name)
    least = F.lit(max(map(len, groups.values())))
    placed = events.where("security is not null").withColumns({"group_order": F.coalesce(order, least), "group": F.coalesce(name, F.lit("other"))})
    key = Window.partitionBy("security", "list")
    lead = F.row_number().over(key.orderBy("group_order", F.desc_nulls_last("pct"), F.desc_nulls_last("last"), "kind", F.desc_nulls_last("value")))
    led = placed.withColumns({"kinds": F.array_sort(F.collect_set("kind").over(key)), "lead": lead}).where("lead = 1")
    rank = F.row_number().over(Window.partitionBy("list", "group_order").orderBy(F.desc("value"), "security"))
    largest = led.where(F.col("value") >= big).withColumn("rank", rank).where(F.col("rank") <= most_lifted).select("list", "security", F.lit(True).alias("lifted"))
    lifted = led.join(largest, ["list", "security"], "left").withColumn("lifted", F.coalesce("lifted", F.lit(False)))
    first = [F.desc("lifted"), F.desc_nulls_last(F.when(F.col("lifted"), F.col("value")).otherwise(F.col("pct"))), F.desc_nulls_last("last"), F.col("security")]
    return numbered_within(lifted, ["list", "group_order"], first).withColumn("place", F.col("place").cast("int")).select("list", "group_order", "group", "place", "security", "kind", "pct", "value", "last", "kinds")


def company_view(events: DataFrame) -> DataFrame:
    """Every event of each security once, by list, size and day, with its kinds: events that agree in all but kind are one row."""
    return events.where("security is not null").groupBy("security", "list", "pct", "value", "last").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def float_pct(value: Column, market_cap: Column, public_pct: Column) -> Column:
    """A trade in percent of the free float; null where a denominator is unknown or not positive."""
    return F.when((market_cap > 0) & (public_pct > 0), value / (market_cap * public_pct / 100) * 100)


def float_absorbers(windows: DataFrame, size: DataFrame, value: str, least_pct: float) -> DataFrame:
    """Persons whose buying in a window reached ``least_pct`` of the free float. ``size``: (security, market_cap, public_pct)."""
    out = windows.join(size, "security").withColumn("float_pct", float_pct(F.col(value), F.col("market_cap"), F.col("public_pct")))
    return out.where(F.col("float_pct") >= least_pct).drop("market_cap", "public_pct")


def latest_rows(df: DataFrame, key: str, day: str, *ties: Column) -> DataFrame:
    """The latest row of each key; rows without a day come last."""
    return df.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(day), *ties))).where("at = 1").drop("at")


def buys_before(trades: DataFrame, keys: list[str], day: str, days: int = 14) -> DataFrame:
    """Every trade with ``buys``: how many buys its keys made in the ``days`` days up to its own."""
    frame = Window.partitionBy(*keys).orderBy(F.datediff(day, F.lit("1970-01-01").cast("date"))).rangeBetween(-(days - 1), 0)
    return dealt(trades, *keys).withColumn("buys", F.sum(F.when(F.col("side") == "BUY", 1).otherwise(0)).over(frame))


def session_rows(trades: DataFrame, session: Column, size: DataFrame) -> DataFrame:
    """One row a security, person and side of one session, tranches summed, with the share of the company and of its float."""
    day = trades.where((F.col("day_to") == session) & F.col("security").isNotNull())
    out = day.groupBy("security", "person", "side").agg(F.sum("value").alias("value"), F.sum("quantity").alias("quantity"), F.count("*").alias("trades")).join(size, "security", "left")
    return out.withColumns({"pct": F.when(F.col("market_cap") > 0, F.col("value") / F.col("market_cap") * 100), "float_pct": float_pct(F.col("value"), F.col("market_cap"), F.col("public_pct"))}).drop("market_cap", "public_pct")


def accumulation(deals: DataFrame, size: DataFrame, ref: Column, days: int, below: float, names: int = 4) -> DataFrame:
    """Companies under ``below`` that were net bought in the window: net, percent of the company, last day, and the largest net buyers by name."""
    window = deals.where(in_window("day", ref, days)).join(size.where(F.col("market_cap") < below), "security")
    net = window.groupBy("security", "client").agg(F.sum(bought("side", "value") - sold("side", "value")).alias("net"), F.max("day").alias("last"), F.max("market_cap").alias("market_cap"))
    place = net.withColumn("place", F.when(F.col("net") > 0, F.row_number().over(Window.partitionBy("security").orderBy(F.desc("net"), "client"))))
    top = F.array_sort(F.collect_list(F.when(F.col("place") <= names, F.struct("place", "client"))))
    out = place.groupBy("security").agg(F.sum("net").alias("net"), F.max("last").alias("last"), F.max("market_cap").alias("market_cap"), top.alias("top")).where("net > 0")
    return out.select("security", "net", (F.col("net") / F.col("market_cap") * 100).alias("pct"), "last", F.array_join(F.transform("top", lambda x: x["client"].cast("string")), ",").alias("net_buyers"))


def who_bought(trades: DataFrame, role: str, maker: Column) -> DataFrame:
    """Per security the persons by role, the decision-makers and the trades of a window of buys, as counts and one line."""
    roles = trades.groupBy("security", role).agg(F.count_distinct("person").alias("n")).groupBy("security").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(role, "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x[role])), ", ").alias("roles"))
    return trades.groupBy("security").agg(F.count_distinct("person").alias("persons"), F.count_distinct(maker).alias("makers"), F.count("*").alias("trades")).join(roles, "security")


def floored(net: DataFrame, least_net: float, least_pct: float) -> DataFrame:
    """Rows whose net, or whose largest share of one company, is large enough either way."""
    return net.where((F.abs("net") >= least_net) | (F.abs("largest_pct") >= least_pct))


def confident(df: DataFrame, rank: dict[str, int], least: str = "medium") -> tuple[DataFrame, DataFrame]:
    """(rows of at least that confidence, one row with the number left out); an unknown word ranks lowest."""
    score = F.lit(0)
    for word, n in rank.items():
        score = F.when(F.col("confidence") == word, F.lit(n)).otherwise(score)
    ok = score >= rank[least]
    return df.where(ok), df.where(~ok).agg(F.count("*").alias("left_out"))


def net_by_manager(deals: DataFrame, manager: str, sub_advised: Column) -> DataFrame:
    """Per manager its clients, how many are sub-advised, bought, sold, net and securities."""
    out = deals.where(F.col(manager).isNotNull()).groupBy(manager).agg(
        F.count_distinct("client").alias("funds"), F.count_distinct(F.when(sub_advised, F.col("client"))).alias("sub_advised"),
        F.round(F.sum(bought("side", "value")), 2).alias("buy"), F.round(F.sum(sold("side", "value")), 2).alias("sell"), F.count_distinct("security").alias("securities"),
    )
    return out.withColumn("net", F.round(F.col("buy") - F.col("sell"), 2))


def sector_flows(ideas: DataFrame, warns: DataFrame, funds: DataFrame, sectors: DataFrame) -> DataFrame:
    """Per sector: insiders' qualified buys and sales, companies behind them, the company bought most, and funds' net.

    ``ideas`` and ``warns``: (security, value); ``funds``: (security, net); ``sectors``: (security, sector).
    """
    sides = ideas.select("security", "value", F.lit("BUY").alias("side")).unionByName(warns.select("security", "value", F.lit("SELL").alias("side"))).join(sectors, "security")
    own = sides.groupBy("sector").agg(
        F.round(F.sum(bought("side", "value")), 2).alias("bought"), F.round(F.sum(sold("side", "value")), 2).alias("sold"), F.count_distinct("security").alias("companies"),
        F.max_by(F.when(F.col("side") == "BUY", F.col("security")), F.when(F.col("side") == "BUY", F.struct("value", -F.col("security")))).alias("top"),
    )
    flows = funds.join(sectors, "security").groupBy("sector").agg(F.round(F.sum("net"), 2).alias("funds_net"))
    return own.join(flows, "sector", "full").na.fill(0, ["bought", "sold", "companies", "funds_net"])


def screened(snapshot: DataFrame, presets: dict[str, Column]) -> DataFrame:
    """(preset, row...) for each named rule that a row passes; a null rule is false. Rules may overlap."""
    passed = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in presets.items()]))
    return snapshot.withColumn("preset", F.explode(passed))
