"""Queries on trades and deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.bindings import DEALS, FILINGS, REF, deals, filings, ref
from tidewater.operators import dedup, trades
from tidewater.sources.files import table

SELLS = "sum(CASE WHEN side = 'SELL' THEN {0} ELSE 0 END)"
BUYS = "sum(CASE WHEN side = 'BUY' THEN {0} ELSE 0 END)"
_b, _s = BUYS.format, SELLS.format


def decisions_topk(spark, folder):
    sound = trades.eligible(filings(spark, folder), F.lit(True), F.col("status") == "X")
    out = trades.decisions(sound, ref()).where(trades.qualifies("value", "days", 30_000, 2))
    return trades.top(out, 50, F.desc("value"), F.col("security"), F.col("person"))


def decisions_sells(spark, folder):
    return trades.decisions(filings(spark, folder), ref(), side="SELL").where(trades.qualifies("value", "days", 30_000, 3)).drop("trades")


def _decisions_sql(side, floor, days, tail=""):
    return f"""WITH {FILINGS}, w AS (SELECT *, day_to > DATE '{REF}' - 90 AS now, day_to <= DATE '{REF}' - 90 AND day_to > DATE '{REF}' - 455 AS old FROM f WHERE side = '{side}' AND day_to <= DATE '{REF}' AND day_to > DATE '{REF}' - 455),
        g AS (SELECT security, person, count(*) FILTER (now) AS trades, round(sum(value) FILTER (now), 2) AS value, sum(quantity) FILTER (now) AS quantity, count(DISTINCT day_to) FILTER (now) AS days,
        min(day_to) FILTER (now) AS first_day, max(day_to) FILTER (now) AS last_day, count(DISTINCT date_trunc('month', day_to)) FILTER (old) AS prior_months FROM w GROUP BY 1, 2)
        SELECT * FROM g WHERE trades > 0 AND (value >= {floor} OR days >= {days}) {tail}"""


def dedup_latest_refiling(spark, folder):
    order = [F.desc("day_to"), F.desc("value"), F.col("security"), F.col("person"), F.col("quantity"), F.col("tax"), F.col("discount")]
    kept, _ = dedup.latest_first(filings(spark, folder), ["order_id", "line"], order)
    return kept.groupBy("order_id").agg(F.count("*").alias("kept"), F.max("day_to").alias("latest"), F.round(F.sum("value"), 2).alias("value"))


def dedup_removed_reasons(spark, folder):
    order = [F.desc("day_to"), F.desc("value"), F.col("security"), F.col("person"), F.col("quantity"), F.col("tax"), F.col("discount")]
    reason = F.when(F.col("side") == "SELL", "resubmitted_sell").otherwise("resubmitted_buy")
    _, removed = dedup.latest_first(filings(spark, folder), ["order_id", "line"], order, reason)
    return dedup.reasons_report(removed, "filings", "order_id").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


_RANK = "row_number() OVER (PARTITION BY order_id, line ORDER BY day_to DESC, value DESC, security, person, quantity, tax, discount)"


def copies_across_feeds(spark, folder):
    d = deals(spark, folder).select("client", "day", "quantity", F.col("event_type").alias("feed"))
    first = d.agg(F.min("feed").alias("f")).first()["f"]
    kept = dedup.copies_in_other_feed(d, ["client", "day"], "feed", first)
    return kept.groupBy("feed").agg(F.count("*").alias("n"))


def refiled_disjoint(spark, folder):
    f = filings(spark, folder).select("person", "security", "order_id", "line", F.col("tax").alias("before"), F.col("discount").alias("after"), "day_to", "value")
    kept, gone = dedup.disjoint_refilings(f, ["person", "security"], "before", "after", [F.desc("day_to"), F.desc("value"), F.desc("order_id"), F.desc("line"), F.desc("before"), F.desc("after")])
    return kept.groupBy("person").agg(F.count("*").alias("kept")).join(gone.groupBy("person").agg(F.count("*").alias("gone")), "person", "left").select("person", "kept", F.coalesce("gone", F.lit(0)).alias("gone"))


def superseded_by_single(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderpriority") == "1-URGENT").alias("revision"))
    out = dedup.superseded_by_single(o, ["who"], "id", "day", "revision")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("original").alias("originals"))


def newest_revision(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("who"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("date").alias("day"))
    return dedup.newest_revision(o, ["who", "year"], "day").groupBy("superseded").agg(F.count("*").alias("n"))


def legs_rollup_vwap(spark, folder):
    d = deals(spark, folder).withColumn("price", F.lit(1.0) + F.col("security") % 7)
    out = trades.roll_up_legs(d, ["client", "day", "side"], "quantity", "price", "event_id", "event_type")
    return out.select("client", "day", "side", F.round("quantity", 2).alias("quantity"), F.round("value", 2).alias("value"), "legs", "feeds", "first_id", "last_id", F.round("vwap", 4).alias("vwap"))


def two_way_netting(spark, folder):
    out = trades.net_two_way(deals(spark, folder), ["client", "day"], "side", "quantity")
    return out.select("client", "day", "side", F.round("net", 2).alias("net"))


def round_trips(spark, folder):
    out = trades.round_trips(deals(spark, folder), ["client", "day"], "side", "quantity", 0.1)
    return out.select("client", "day", F.round("buy", 2).alias("buy"), F.round("sell", 2).alias("sell"))


def market_makers(spark, folder):
    d = deals(spark, folder)
    ends = d.select(F.date_add(F.trunc("day", "week"), 6).alias("period_end")).distinct()
    out = trades.market_makers(d, "client", "day", "side", "quantity", ends, days=7, least_legs=5, balance=0.5)
    return out.select("client", "period_end", "legs", F.round("buy", 2).alias("buy"), F.round("sell", 2).alias("sell"))


def handshakes(spark, folder):
    out = trades.handshakes(deals(spark, folder), ["security", "day"], "client", "side", "quantity")
    return out.select("security", "day", "buyers", "sellers", F.round("matched", 2).alias("matched"))


def investors_net(spark, folder):
    return trades.net_by(filings(spark, folder), ["person"], "security", "side", "value")


def net_by_type(spark, folder):
    d = deals(spark, folder)
    return trades.net_by(d, ["event_type"], "client", "side", "quantity")


def buyers_sellers(spark, folder):
    net = filings(spark, folder).groupBy("security").agg(F.round(F.sum(trades.signed("side", "value")), 2).alias("net"))
    buyers = trades.top(net.where("net > 0"), 10, F.desc("net"), F.col("security")).withColumn("list", F.lit("buy"))
    sellers = trades.top(net.where("net < 0"), 10, F.col("net"), F.col("security")).withColumn("list", F.lit("sell"))
    return buyers.unionByName(sellers)


def insider_breadth(spark, folder):
    f = filings(spark, folder)
    out = trades.breadth(f, "day_to", ref(), 90, "side", "value", "security", F.col("line") <= 4, F.col("quantity") < 5)
    return out.select(*(F.round(c, 4).alias(c) if "value" in c or "share" in c else c for c in out.columns))


def person_windows(spark, folder):
    return trades.person_windows(filings(spark, folder), ref())


def spotlight(spark, folder):
    share = trades.person_windows(filings(spark, folder), ref()).join(table(spark, folder, "part").select(F.col("p_partkey").alias("security"), "p_retailprice"), "security")
    return share.withColumn("pct", F.round(F.col("value_30d") / (F.col("p_retailprice") * 1000) * 100, 6)).where("pct >= 0.15").select("security", "person", "value_30d", "pct")


def clusters(spark, folder):
    f = filings(spark, folder).withColumn("in_group", F.col("person") % 10 == 0)
    return trades.clusters(f, ref())


def company_board(spark, folder):
    f = filings(spark, folder).where(trades.in_window("day_to", ref(), 90))
    out = f.groupBy("security").agg(F.round(F.sum(trades.signed("side", "value")), 2).alias("net"), F.count_distinct("person").alias("people"), F.count_if(F.col("side") == "SELL").alias("sells"))
    badges = F.array_compact(F.array(F.when(F.col("people") >= 2, "many_people"), F.when(F.col("sells") == 0, "only_buys"), F.when(F.col("net") < 0, "net_sold")))
    return out.select("security", "net", "people", F.array_join(badges, ",").alias("badges"))


def red_flags(spark, folder):
    f = filings(spark, folder).groupBy("security").agg(F.sum(trades.sold("side", "value")).alias("sold"), F.sum(trades.bought("side", "value")).alias("bought"), F.count_if(F.col("day_to") < F.col("day_from")).alias("late"), F.count("*").alias("n"))
    flags = F.array_compact(F.array(F.when(F.col("sold") > F.col("bought"), "more_sold"), F.when(F.col("late") * 2 > F.col("n"), "dates_out_of_order"), F.when(F.col("n") >= 35, "busy")))
    return f.withColumn("flags", flags).where(F.size("flags") >= 2).select("security", F.size("flags").alias("n_flags"), F.array_join("flags", ",").alias("flags"))


def club_blocks(spark, folder):
    d = deals(spark, folder).withColumn("price", F.round("quantity", 0))
    out = trades.blocks(d, ["day", "side"], "client", "price", "quantity")
    return out.select("day", "side", "price", "persons", F.round("quantity", 2).alias("quantity"), F.array_join("named", ",").alias("named"))


def top_names_by_security(spark, folder):
    net = filings(spark, folder).groupBy("security", "person").agg(F.round(F.sum(trades.signed("side", "value")), 2).alias("net"))
    return trades.top_within(net.where("net > 0"), ["security"], 3, F.desc("net"), F.col("person"))


def as_of_day(spark, folder):
    return trades.as_of_day(filings(spark, folder), "day_to", ref())


def convergence(spark, folder):
    f = filings(spark, folder).where(trades.in_window("day_to", ref(), 180) & (F.col("side") == "BUY"))
    kinds = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("person"), (F.col("s_nationkey") % 4).alias("kind"))
    return f.join(kinds, "person").groupBy("security").agg(F.count_distinct("kind").alias("kinds"), F.round(F.sum("value"), 2).alias("value")).where("kinds >= 2")


_NET = f"round({_b('value')} - {_s('value')}, 2)"

QUERIES = {f.__name__: f for f in (decisions_topk, decisions_sells, dedup_latest_refiling, dedup_removed_reasons, copies_across_feeds, refiled_disjoint, superseded_by_single, newest_revision, legs_rollup_vwap, two_way_netting, round_trips, market_makers, handshakes, investors_net, net_by_type, buyers_sellers, insider_breadth, person_windows, spotlight, clusters, company_board, red_flags, club_blocks, top_names_by_security, as_of_day, convergence)}

_NETBY = """per AS (SELECT {0}, {1} AS sec, {2} AS b, {3} AS s, count(*) AS n FROM {4} GROUP BY 1, 2)
    SELECT {0}, round(sum(b), 2) AS bought, round(sum(s), 2) AS sold, round(sum(b - s), 2) AS net, sum(n)::BIGINT AS deals, count(*) AS securities,
    arg_max(sec, {{'a': round(abs(b - s), 2), 'b': sec}}) AS largest FROM per GROUP BY 1"""

ORACLE_SQL = {
    "decisions_topk": _decisions_sql("BUY", 30_000, 2, "ORDER BY value DESC, security, person LIMIT 50"),
    "decisions_sells": _decisions_sql("SELL", 30_000, 3).replace("SELECT * FROM g", "SELECT * EXCLUDE (trades) FROM g"),
    "dedup_latest_refiling": f"WITH {FILINGS}, r AS (SELECT *, {_RANK} AS p FROM f) SELECT order_id, count(*) AS kept, max(day_to) AS latest, round(sum(value), 2) AS value FROM r WHERE p = 1 GROUP BY 1",
    "dedup_removed_reasons": f"""WITH {FILINGS}, r AS (SELECT *, {_RANK} AS p FROM f), x AS (SELECT CASE WHEN side = 'SELL' THEN 'resubmitted_sell' ELSE 'resubmitted_buy' END AS reason, order_id FROM r WHERE p > 1)
        SELECT 'filings' AS table_name, reason, count(*) AS n, array_to_string(list_sort(list(order_id ORDER BY order_id))[1:25], ',') AS examples FROM x GROUP BY reason""",
    "copies_across_feeds": f"""WITH {DEALS}, m AS (SELECT min(event_type) AS f FROM d) SELECT event_type AS feed, count(*) AS n FROM d WHERE event_type = (SELECT f FROM m)
        OR NOT EXISTS (SELECT 1 FROM d e WHERE e.event_type = (SELECT f FROM m) AND e.client = d.client AND e.day = d.day) GROUP BY 1""",
    "refiled_disjoint": f"""WITH {FILINGS}, k AS (SELECT person, security, list(DISTINCT tax) AS a, list(DISTINCT discount) AS b FROM f GROUP BY 1, 2),
        r AS (SELECT f.person, list_has_any(k.a, k.b) AS meets, row_number() OVER (PARTITION BY f.person, f.security ORDER BY day_to DESC, value DESC, order_id DESC, line DESC, tax DESC, discount DESC) AS p FROM f JOIN k ON f.person = k.person AND f.security = k.security)
        SELECT person, count(*) FILTER (meets OR p = 1) AS kept, count(*) FILTER (NOT meets AND p > 1) AS gone FROM r GROUP BY 1""",
    "superseded_by_single": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS who, CAST(o_orderdate AS DATE) AS day, o_orderpriority = '1-URGENT' AS rev FROM orders),
        c AS (SELECT a.id, a.who, a.day, count(DISTINCT b.id) AS n, min(b.id) AS e FROM o a LEFT JOIN o b ON a.who = b.who AND NOT b.rev AND b.day < a.day WHERE a.rev GROUP BY 1, 2, 3)
        SELECT CASE WHEN n = 1 THEN 'replaces' WHEN n > 1 THEN 'ambiguous' ELSE 'no_original' END AS status, count(*) AS n, sum(CASE WHEN n = 1 THEN e END)::BIGINT AS originals FROM c GROUP BY 1""",
    "newest_revision": "WITH o AS (SELECT o_orderdate < max(o_orderdate) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS superseded FROM orders) SELECT superseded, count(*) AS n FROM o GROUP BY 1",
    "legs_rollup_vwap": f"""WITH {DEALS}, p AS (SELECT *, 1.0::DOUBLE + security % 7 AS price FROM d) SELECT client, day, side, round(sum(quantity), 2) AS quantity, round(sum(quantity * price), 2) AS value, count(*) AS legs,
        string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS feeds, min(event_id) AS first_id, max(event_id) AS last_id, round(CASE WHEN sum(quantity) > 0 THEN sum(quantity * price) / sum(quantity) END, 4) AS vwap FROM p GROUP BY 1, 2, 3""",
    "two_way_netting": f"WITH {DEALS}, g AS (SELECT client, day, {_b('quantity')} AS b, {_s('quantity')} AS s FROM d GROUP BY 1, 2) SELECT client, day, CASE WHEN b > s THEN 'BUY' ELSE 'SELL' END AS side, round(abs(b - s), 2) AS net FROM g WHERE b <> s",
    "round_trips": f"WITH {DEALS}, g AS (SELECT client, day, {_b('quantity')} AS b, {_s('quantity')} AS s FROM d GROUP BY 1, 2) SELECT client, day, round(b, 2) AS buy, round(s, 2) AS sell FROM g WHERE b > 0 AND s > 0 AND abs(b - s) <= 0.1::DOUBLE * greatest(b, s)",
    "market_makers": f"""WITH {DEALS}, e AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) + 6 AS period_end FROM d), g AS (SELECT client, period_end, count(*) AS legs, {_b('quantity')} AS b, {_s('quantity')} AS s
        FROM d JOIN e ON day <= period_end AND day > period_end - 7 GROUP BY 1, 2) SELECT client, period_end, legs, round(b, 2) AS buy, round(s, 2) AS sell FROM g WHERE legs >= 5 AND least(b, s) >= 0.5 * greatest(b, s)""",
    "handshakes": f"""WITH {DEALS}, n AS (SELECT security, day, client, {_b('quantity')} - {_s('quantity')} AS net FROM d GROUP BY 1, 2, 3), g AS (SELECT security, day, sum(greatest(net, 0)) AS b, sum(greatest(-net, 0)) AS s,
        count(*) FILTER (net > 0) AS buyers, count(*) FILTER (net < 0) AS sellers FROM n GROUP BY 1, 2) SELECT security, day, buyers, sellers, round(least(b, s), 2) AS matched FROM g WHERE buyers > 0 AND sellers > 0""",
    "investors_net": f"WITH {FILINGS}, " + _NETBY.format("person", "security", _b("value"), _s("value"), "f"),
    "net_by_type": f"WITH {DEALS}, " + _NETBY.format("event_type", "client", _b("quantity"), _s("quantity"), "d"),
    "buyers_sellers": f"""WITH {FILINGS}, n AS (SELECT security, {_NET} AS net FROM f GROUP BY 1)
        (SELECT security, net, 'buy' AS list FROM n WHERE net > 0 ORDER BY net DESC, security LIMIT 10) UNION ALL (SELECT security, net, 'sell' FROM n WHERE net < 0 ORDER BY net, security LIMIT 10)""",
    "insider_breadth": f"""WITH {FILINGS}, w AS (SELECT security, side, value, quantity >= 5 AS sized, day_to > DATE '{REF}' - 90 AS now, day_to > DATE '{REF}' - 180 AND day_to <= DATE '{REF}' - 90 AS old, min(day_to) OVER () <= DATE '{REF}' - 179 AS reaches
        FROM f WHERE line <= 4 AND day_to <= DATE '{REF}'),
        g AS (SELECT any_value(reaches) AS reaches, coalesce(sum(value) FILTER (now AND side = 'BUY' AND sized), 0) AS bv, coalesce(sum(value) FILTER (now AND side = 'SELL'), 0) AS sv, coalesce(sum(value) FILTER (old AND side = 'BUY' AND sized), 0) AS bo, coalesce(sum(value) FILTER (old AND side = 'SELL'), 0) AS so,
        count(DISTINCT security) FILTER (now AND side = 'BUY' AND sized) AS bs, count(DISTINCT security) FILTER (now AND side = 'SELL') AS ss, count(DISTINCT security) FILTER (old AND side = 'BUY' AND sized) AS ob, count(DISTINCT security) FILTER (old AND side = 'SELL') AS os FROM w)
        SELECT round(bv, 4) AS buy_value, bs AS buy_securities, round(sv, 4) AS sell_value, ss AS sell_securities, round(100 * bv / nullif(bv + sv, 0), 4) AS buy_share, CASE WHEN reaches THEN round(bo, 4) END AS buy_value_before, CASE WHEN reaches THEN ob END AS buy_securities_before,
        CASE WHEN reaches THEN round(so, 4) END AS sell_value_before, CASE WHEN reaches THEN os END AS sell_securities_before, CASE WHEN reaches THEN round(100 * bo / nullif(bo + so, 0), 4) END AS buy_share_before FROM g""",
    "person_windows": f"WITH {FILINGS} SELECT security, person, round(sum(CASE WHEN side = 'BUY' AND day_to > DATE '{REF}' - 30 THEN value ELSE 0 END), 2) AS value_30d, round({_b('value')}, 2) AS value_90d FROM f WHERE day_to > DATE '{REF}' - 90 AND day_to <= DATE '{REF}' GROUP BY 1, 2",
    "spotlight": f"""WITH {FILINGS}, w AS (SELECT security, person, round(sum(CASE WHEN side = 'BUY' AND day_to > DATE '{REF}' - 30 THEN value ELSE 0 END), 2) AS value_30d FROM f WHERE day_to > DATE '{REF}' - 90 AND day_to <= DATE '{REF}' GROUP BY 1, 2)
        SELECT security, person, value_30d, round(value_30d / (p_retailprice * 1000) * 100, 6) AS pct FROM w JOIN part ON p_partkey = security WHERE round(value_30d / (p_retailprice * 1000) * 100, 6) >= 0.15""",
    "clusters": f"""WITH {FILINGS} SELECT security, count(DISTINCT CASE WHEN person % 10 = 0 THEN 'GROUP' ELSE CAST(person AS VARCHAR) END) AS makers, round(sum(value), 2) AS value FROM f
        WHERE side = 'BUY' AND day_to > DATE '{REF}' - 30 AND day_to <= DATE '{REF}' GROUP BY 1 HAVING count(DISTINCT CASE WHEN person % 10 = 0 THEN 'GROUP' ELSE CAST(person AS VARCHAR) END) >= 2""",
    "company_board": f"""WITH {FILINGS}, g AS (SELECT security, {_NET} AS net, count(DISTINCT person) AS people, count(*) FILTER (side = 'SELL') AS sells FROM f WHERE day_to > DATE '{REF}' - 90 AND day_to <= DATE '{REF}' GROUP BY 1)
        SELECT security, net, people, concat_ws(',', CASE WHEN people >= 2 THEN 'many_people' END, CASE WHEN sells = 0 THEN 'only_buys' END, CASE WHEN net < 0 THEN 'net_sold' END) AS badges FROM g""",
    "red_flags": f"""WITH {FILINGS}, g AS (SELECT security, {_s('value')} AS s, {_b('value')} AS b, count(*) FILTER (day_to < day_from) AS late, count(*) AS n FROM f GROUP BY 1),
        x AS (SELECT security, list_filter([CASE WHEN s > b THEN 'more_sold' END, CASE WHEN late * 2 > n THEN 'dates_out_of_order' END, CASE WHEN n >= 35 THEN 'busy' END], lambda v: v IS NOT NULL) AS flags FROM g)
        SELECT security, len(flags)::INT AS n_flags, array_to_string(flags, ',') AS flags FROM x WHERE len(flags) >= 2""",
    "club_blocks": f"""WITH {DEALS} SELECT day, side, round(round(quantity, 0), 1) AS price, count(DISTINCT client) AS persons, round(sum(quantity), 2) AS quantity, array_to_string(list_sort(list(DISTINCT client))[1:3], ',') AS named FROM d GROUP BY 1, 2, 3 HAVING count(DISTINCT client) >= 3""",
    "top_names_by_security": f"WITH {FILINGS}, n AS (SELECT security, person, {_NET} AS net FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY security ORDER BY net DESC, person)::INT AS rank FROM n WHERE net > 0) SELECT * FROM r WHERE rank <= 3",
    "as_of_day": f"WITH {FILINGS} SELECT max(day_to) AS ref FROM f WHERE day_to <= DATE '{REF}'",
    "convergence": f"""WITH {FILINGS} SELECT security, count(DISTINCT s_nationkey % 4) AS kinds, round(sum(value), 2) AS value FROM f JOIN supplier ON s_suppkey = person
        WHERE side = 'BUY' AND day_to > DATE '{REF}' - 180 AND day_to <= DATE '{REF}' GROUP BY 1 HAVING count(DISTINCT s_nationkey % 4) >= 2""",
}
