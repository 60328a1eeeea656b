"""Queries on signals: events, the two lists of a day, boards, funds' holdings and the price layer's factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.bindings import BARS, DEALS, FILINGS, REF, bars, deals, filings, ref
from tidewater.operators import holdings, periods, signals, trades
from tidewater.sources.files import table

#: A company's size is a thousand times its part's retail price; its free float 30 to 69 percent by part number.
_SIZE = "z AS (SELECT p_partkey AS security, p_retailprice * 1000 AS market_cap, CAST(30 + p_partkey % 40 AS DOUBLE) AS public_pct FROM part)"
_WINDOW = f"day_to > DATE '{REF}' - 90 AND day_to <= DATE '{REF}'"
_GROUPS = {
    "look": [("insiders_buying", ["group_buying", "officer_buying", "cluster", "spotlight", "steady"]), ("big_investors_in", ["big_investor_in", "funds_buying"])],
    "warn": [("insiders_selling", ["group_selling", "officer_selling"]), ("big_investors_out", ["big_investor_out", "funds_selling"])],
}
_BIG = 60_000.0


def _size(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("security"), (F.col("p_retailprice") * 1000).alias("market_cap"), (30 + F.col("p_partkey") % 40).cast("double").alias("public_pct"))


def _sized_decisions(spark, folder, side):
    d = trades.decisions(filings(spark, folder), ref(), side=side)
    return d.join(_size(spark, folder), "security").withColumn("pct", F.round(F.col("value") / F.col("market_cap") * 100, 6)).drop("market_cap", "public_pct")


def _group():
    return F.col("person") % 10 == 0


def _officer():
    return F.col("person") % 10 < 6


def _ideas(spark, folder):
    d = _sized_decisions(spark, folder, "BUY").where(trades.qualifies("value", "days", 30_000, 2))
    f = filings(spark, folder).withColumn("in_group", F.col("person") % 10 == 0)
    spot = trades.person_windows(f, ref()).join(_size(spark, folder), "security").where(F.col("value_30d") / F.col("market_cap") * 100 >= 3.5)
    return signals.idea_kinds(d, _group(), _officer(), F.col("days") >= 2, trades.clusters(f, ref()), spot)


def worth_a_look(spark, folder):
    return _ideas(spark, folder).select("security", "lead", "makers", F.round("pct", 6).alias("pct"), F.round("value", 2).alias("value"), "last", F.array_join("kinds", ",").alias("kinds"))


def _warnings(spark, folder):
    return signals.warnings(_sized_decisions(spark, folder, "SELL"), _group(), trades.qualifies("value", "days", 30_000, 3), _BIG)


def watch_out(spark, folder):
    return _warnings(spark, folder).select("security", F.round("pct", 6).alias("pct"), F.round("value", 2).alias("value"), "makers", "last", "kind")


def _stakes(spark, folder):
    f = filings(spark, folder)
    side = lambda s, c: F.when(F.col("side") == s, F.col(c) * 100)
    return f.select("security", F.col("person").alias("holder"), F.round(side("BUY", "tax"), 2).alias("pct_bought"), F.round(side("SELL", "tax"), 2).alias("pct_sold"), F.round(F.col("discount") * 100, 2).alias("pct_after"), F.col("day_to").alias("day"))


def stake_events(spark, folder):
    return signals.stake_events(_stakes(spark, folder)).groupBy("security", "list", "kind").agg(F.count("*").alias("n"), F.round(F.max("pct"), 2).alias("largest"), F.max("last").alias("last"))


def _funds(spark, folder):
    d = deals(spark, folder).where(F.col("client") % 3 == 0).withColumn("value", F.col("quantity") * 100)
    return signals.flow_events(d.select("security", "side", "value", "day"), _size(spark, folder), ("funds_buying", "funds_selling"), 0.25)


def fund_events(spark, folder):
    return _funds(spark, folder).select("security", "list", "kind", F.round("pct", 6).alias("pct"), F.round("value", 2).alias("value"), "last")


def pledge_events(spark, folder):
    f = filings(spark, folder)
    p = f.select("security", "person", "quantity", F.when(F.col("side") == "BUY", "create").otherwise("revoke").alias("kind"), (F.col("tax") * 1000).alias("held"), F.col("day_to").alias("day"))
    shares = table(spark, folder, "part").select(F.col("p_partkey").alias("security"), (F.col("p_size") * 100).alias("total"))
    return signals.pledge_events(p, shares).select("security", "list", "kind", F.round("pct", 6).alias("pct"), "last")


def today_board(spark, folder):
    parts = signals.insider_events(_ideas(spark, folder), _warnings(spark, folder)).unionByName(signals.stake_events(_stakes(spark, folder).where(trades.in_window("day", ref(), 30)))).unionByName(_funds(spark, folder))
    rounded = parts.withColumns({"pct": F.round("pct", 6), "value": F.round("value", 2)})
    out = signals.today(rounded, _GROUPS, _BIG)
    return out.select("list", "group", "place", "security", "kind", "pct", "value", "last", F.array_join("kinds", ",").alias("kinds"))


def company_view(spark, folder):
    look = _ideas(spark, folder).withColumns({"pct": F.round("pct", 6), "value": F.round("value", 2)})
    return signals.company_view(signals.insider_events(look, _warnings(spark, folder).withColumns({"pct": F.round("pct", 6), "value": F.round("value", 2)}))).withColumn("kinds", F.array_join("kinds", ","))


def float_absorbers(spark, folder):
    w = trades.person_windows(filings(spark, folder), ref())
    return signals.float_absorbers(w, _size(spark, folder), "value_90d", 10.0).select("security", "person", F.round("float_pct", 6).alias("float_pct"))


def latest_shareholding(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return signals.latest_rows(o, "who", "day", F.desc("id")).select("who", "day", "id", "o_totalprice")


def buys_in_days(spark, folder):
    f = filings(spark, folder)
    return signals.buys_before(f, ["security", "person"], "day_to").groupBy("security", "person").agg(F.max("buys").alias("most"), F.count("*").alias("n"))


def session_by_company(spark, folder):
    out = signals.session_rows(filings(spark, folder), ref(), _size(spark, folder))
    return out.select("security", "person", "side", F.round("value", 2).alias("value"), "quantity", "trades", F.round("pct", 6).alias("pct"), F.round("float_pct", 6).alias("float_pct"))


def small_cap_accumulation(spark, folder):
    d = deals(spark, folder)
    last = F.lit("2024-01-31").cast("date")
    out = signals.accumulation(d.withColumn("value", F.round("quantity", 2)), _size(spark, folder), last, 30, 1_000_000)
    return out.select("security", F.round("net", 2).alias("net"), F.round("pct", 8).alias("pct"), "last")


def insider_details(spark, folder):
    f = filings(spark, folder).where(trades.in_window("day_to", ref(), 90) & (F.col("side") == "BUY"))
    role = f.withColumn("role", F.when(F.col("person") % 10 == 0, "group").when(F.col("person") % 10 < 6, "officer").otherwise("other"))
    maker = F.when(F.col("role") == "group", F.lit("GROUP")).otherwise(F.col("person").cast("string"))
    return signals.who_bought(role, "role", maker)


def net_by_manager(spark, folder):
    d = deals(spark, folder).withColumns({"value": F.col("quantity"), "manager": F.when(F.col("client") % 5 < 4, F.concat(F.lit("m"), (F.col("client") % 5).cast("string")))})
    return signals.net_by_manager(d, "manager", F.col("client") % 2 == 0)


def investors_floored(spark, folder):
    per = filings(spark, folder).groupBy("person", "security").agg(F.sum(trades.signed("side", "value")).alias("v")).join(_size(spark, folder), "security").withColumn("p", F.round(F.col("v") / F.col("market_cap") * 100, 6))
    net = per.groupBy("person").agg(F.round(F.sum("v"), 2).alias("net"), F.max_by("p", F.struct(F.abs("p"), "p")).alias("largest_pct"))
    return signals.floored(net, 9_000_000, 60.0)


def sector_rollup(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("security"), F.element_at(F.split("p_type", " "), 1).alias("sector"))
    d = deals(spark, folder).groupBy("security").agg(F.sum(trades.signed("side", "quantity")).alias("net"))
    return signals.sector_flows(_ideas(spark, folder).withColumn("value", F.round("value", 2)), _warnings(spark, folder).withColumn("value", F.round("value", 2)), d, p)


def screener_presets(spark, folder):
    f = filings(spark, folder).groupBy("security").agg(F.round(F.sum(trades.signed("side", "value")), 2).alias("net"), F.count_distinct("person").alias("people"), F.max("day_to").alias("last"))
    snap = f.join(_size(spark, folder), "security", "left")
    rules = {"net_bought": F.col("net") > 0, "many_people": F.col("people") >= 25, "small": F.col("market_cap") < 1_000_000, "closely_held": F.col("public_pct") < 35}
    return signals.screened(snap, rules).select("preset", "security", "net", "people", "last")


def _months(spark, folder):
    """(house, security, month, shares, value, name): an order's nation of customers holds its parts in the month it was placed."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("second"), F.col("c_nationkey").alias("house"))
    f = filings(spark, folder).join(c, "second")
    return f.groupBy("house", "security", ((F.year("day_from") - 1990) * 12 + F.month("day_from")).alias("month")).agg(F.sum("quantity").alias("shares"), F.round(F.sum("value"), 2).alias("value"))


def holdings_by_stock(spark, folder):
    m = _months(spark, folder)
    ch = periods.successive_changes(m, ["house", "security"], "month", "shares").join(m.select("house", "security", "month", "value"), ["house", "security", "month"], "left")
    cents = F.round(F.col("value") * 100).cast("long")  # whole numbers: their sums do not depend on the order
    out = holdings.by_security(ch.select(F.concat_ws(":", "month", "security").alias("security"), "house", "kind", "change", "after", cents.alias("value")))
    key = F.split("security", ":")
    return out.select(key[0].cast("int").alias("month"), key[1].cast("bigint").alias("security"), "adding", "cutting", "starting", "leaving", F.round("net", 2).alias("net"), "holding", F.floor(F.col("price") + 0.5).alias("price_cents"), F.floor(F.col("net_value") + 0.5).alias("net_cents"))


def first_held(spark, folder):
    m = _months(spark, folder)
    per = m.groupBy("security", "month").agg(F.lit(0.0).alias("before"))
    return holdings.first_held(per, "security", "month", "before")


def renamed_securities(spark, folder):
    """A nation's parts of 1996 and of 1997, under the names of their types and sizes."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("second"), F.col("c_nationkey").alias("house"))
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("security"), F.concat_ws(" ", "p_type", "p_size").alias("name"))
    f = filings(spark, folder).join(c, "second").join(p, "security").select("house", "security", "name", F.year("day_from").alias("year"))
    return holdings.renamed_securities(f.where("year = 1997"), f.where("year = 1996"), "house", "security", "name")


def fund_rollup(spark, folder):
    p = table(spark, folder, "part").where("p_size > 5").select(F.col("p_partkey").alias("security"), F.col("p_brand").alias("label"))
    moves = deals(spark, folder).groupBy("security").agg(F.round(F.sum(trades.signed("side", "quantity")), 4).alias("net"))
    return holdings.rollup(moves, p, "security", "label", "net")


def bucket_rollup(spark, folder):
    p = table(spark, folder, "part").where("p_size > 5").select(F.col("p_partkey").alias("security"), F.when(F.col("p_retailprice") > 1200, "Large").when(F.col("p_retailprice") > 1000, "Mid").otherwise("Small").alias("bucket"))
    moves = deals(spark, folder).groupBy("security").agg(F.round(F.sum(trades.signed("side", "quantity")), 4).alias("net"))
    return holdings.bucket_rollup(moves, p, "security", "net", "net")


def _actions(spark, folder):
    li = table(spark, folder, "lineitem")
    purpose = F.when(F.col("l_linenumber") == 1, F.when(F.col("l_returnflag") == "N", "Bonus").otherwise("dividend")).otherwise("split")
    return li.select(F.col("l_partkey").alias("security"), purpose.alias("purpose"), F.col("l_shipdate").cast("date").alias("ex_day"), (F.col("l_quantity") % 3).alias("new_for"), F.lit(2.0).alias("held"), F.lit(10.0).alias("face_from"), (F.col("l_quantity") % 5 + 1).alias("face_to"))


def expected_factors(spark, folder):
    return holdings.expected_factors(_actions(spark, folder)).select("security", "ex_day", F.round("expected", 8).alias("expected"), "split_bonus")


def share_factors(spark, folder):
    out = holdings.share_factors(holdings.expected_factors(_actions(spark, folder)), F.lit("1997-01-31").cast("date"), F.lit("1997-02-28").cast("date"))
    return out.select("security", F.round("factor", 6).alias("factor"))


def clean_ratios(spark, folder):
    b = bars(spark, folder)
    return b.groupBy(holdings.is_clean_ratio(F.round(F.col("low") / F.col("high"), 6)).alias("clean")).agg(F.count("*").alias("n"))


def basket_nav(spark, folder):
    b = bars(spark, folder).select("security", "day", "close")
    pos = filings(spark, folder).where("side = 'BUY'").groupBy("security").agg(F.min("day_to").alias("entry_day"), F.max("day_to").alias("last")).select("security", "entry_day", F.when(F.col("last") > F.col("entry_day"), F.col("last")).alias("exit_day"))
    return holdings.basket_nav(pos, b, 0.25).select("day", "open_positions", F.round("mean_return", 6).alias("mean_return"), F.round("nav", 4).alias("nav"))


QUERIES = {f.__name__: f for f in (worth_a_look, watch_out, stake_events, fund_events, pledge_events, today_board, company_view, float_absorbers, latest_shareholding, buys_in_days, session_by_company, small_cap_accumulation, insider_details, net_by_manager, investors_floored, sector_rollup, screener_presets, holdings_by_stock, first_held, renamed_securities, fund_rollup, bucket_rollup, expected_factors, share_factors, clean_ratios, basket_nav)}


def _dec(side, where):
    return f"""SELECT g.security, person, value, quantity, days, last_day, round(value / market_cap * 100, 6) AS pct FROM (SELECT security, person, round(sum(value), 2) AS value, sum(quantity) AS quantity, count(DISTINCT day_to) AS days, max(day_to) AS last_day
        FROM f WHERE side = '{side}' AND {_WINDOW} GROUP BY 1, 2) g JOIN z ON z.security = g.security WHERE {where}"""


_IDEAS = f"""{FILINGS}, {_SIZE}, db AS ({_dec('BUY', '(value >= 30000 OR days >= 2)')}),
    cl AS (SELECT security FROM f WHERE side = 'BUY' AND day_to > DATE '{REF}' - 30 AND day_to <= DATE '{REF}' GROUP BY 1 HAVING count(DISTINCT CASE WHEN person % 10 = 0 THEN 'GROUP' ELSE CAST(person AS VARCHAR) END) >= 2),
    sp AS (SELECT DISTINCT w.security FROM (SELECT security, person, round(sum(CASE WHEN side = 'BUY' AND day_to > DATE '{REF}' - 30 THEN value ELSE 0 END), 2) AS v FROM f WHERE {_WINDOW} GROUP BY 1, 2) w JOIN z ON z.security = w.security WHERE v / market_cap * 100 >= 3.5),
    look AS (SELECT security, arg_max(person, {{'a': pct, 'b': -person}}) AS lead, count(*) AS makers, round(sum(pct), 6) AS pct, round(sum(value), 2) AS value, max(last_day) AS last,
        list_filter([CASE WHEN bool_or(person % 10 = 0) THEN 'group_buying' END, CASE WHEN bool_or(person % 10 <> 0 AND person % 10 < 6) THEN 'officer_buying' END, CASE WHEN security IN (SELECT security FROM cl) THEN 'cluster' END,
            CASE WHEN security IN (SELECT security FROM sp) THEN 'spotlight' END, CASE WHEN bool_or(days >= 2) THEN 'steady' END], lambda x: x IS NOT NULL) AS kinds FROM db GROUP BY security)"""
_WARN = f"""ds AS ({_dec('SELL', f"((person % 10 = 0 AND (value >= 30000 OR days >= 3)) OR (person % 10 <> 0 AND value >= {_BIG}::DOUBLE))")}),
    warn AS (SELECT security, round(sum(pct), 6) AS pct, round(sum(value), 2) AS value, count(*) AS makers, max(last_day) AS last, CASE WHEN bool_or(person % 10 = 0) THEN 'group_selling' ELSE 'officer_selling' END AS kind FROM ds GROUP BY 1)"""
_STAKES = """st AS (SELECT security, holder, b, s, a, max(day) AS last FROM (SELECT security, person AS holder, round(CASE WHEN side = 'BUY' THEN tax * 100 END, 2) AS b, round(CASE WHEN side = 'SELL' THEN tax * 100 END, 2) AS s, round(discount * 100, 2) AS a, day_to AS day FROM f) {where} GROUP BY 1, 2, 3, 4, 5),
    se AS (SELECT security, CASE WHEN up THEN 'look' ELSE 'warn' END AS list, CASE WHEN up THEN 'big_investor_in' ELSE 'big_investor_out' END AS kind, CASE WHEN up THEN b ELSE s END AS pct, NULL::DOUBLE AS value, last
        FROM (SELECT *, coalesce(b > 0 AND (b >= 2 OR (a >= 5 AND a - b < 5)), false) AS up, coalesce(s > 0 AND (s >= 2 OR (a < 5 AND a + s >= 5)), false) AS down FROM st) WHERE up OR down)"""
_FUNDS = f"""fe AS (SELECT n.security, CASE WHEN net > 0 THEN 'look' ELSE 'warn' END AS list, CASE WHEN net > 0 THEN 'funds_buying' ELSE 'funds_selling' END AS kind, round(abs(net / market_cap * 100), 6) AS pct, round(abs(net), 2) AS value, last
    FROM (SELECT d.security, sum(CASE WHEN side = 'SELL' THEN -quantity * 100 ELSE quantity * 100 END) AS net, max(day) AS last FROM d WHERE client % 3 = 0 GROUP BY 1) n JOIN z ON z.security = n.security WHERE abs(net / market_cap * 100) >= 0.25)"""
_MONTHS = f"""{FILINGS}, m AS (SELECT c_nationkey AS house, security, (year(day_from) - 1990) * 12 + month(day_from) AS month, sum(quantity) AS shares, round(sum(value), 2) AS value FROM f JOIN customer ON c_custkey = second GROUP BY 1, 2, 3)"""
_ACTIONS = """a AS (SELECT DISTINCT l_partkey AS security, CAST(l_shipdate AS DATE) AS ex_day, CASE WHEN l_linenumber <> 1 THEN 'split' WHEN l_returnflag = 'N' THEN 'bonus' ELSE 'dividend' END AS purpose,
        CASE WHEN l_linenumber <> 1 THEN (l_quantity % 5 + 1) / 10.0::DOUBLE WHEN l_returnflag = 'N' AND l_quantity % 3 > 0 THEN 2.0::DOUBLE / (2.0::DOUBLE + l_quantity % 3) END AS factor FROM lineitem),
    x AS (SELECT security, ex_day, CASE WHEN bool_or(purpose <> 'dividend') THEN exp(sum(ln(factor))) END AS expected, bool_or(purpose <> 'dividend') AS split_bonus FROM a GROUP BY 1, 2)"""
_NET = "sum(CASE WHEN side = 'SELL' THEN -{0} ELSE {0} END)"

_ORDER = "CASE " + " ".join(f"WHEN list = '{lst}' AND kind IN ({', '.join(repr(m) for m in members)}) THEN {i}" for lst, named in _GROUPS.items() for i, (_, members) in enumerate(named)) + " ELSE 2 END"
_NAME = "CASE " + " ".join(f"WHEN list = '{lst}' AND kind IN ({', '.join(repr(m) for m in members)}) THEN '{name}'" for lst, named in _GROUPS.items() for name, members in named) + " ELSE 'other' END"

ORACLE_SQL = {
    "worth_a_look": f"WITH {_IDEAS} SELECT * REPLACE (array_to_string(kinds, ',') AS kinds) FROM look",
    "watch_out": f"WITH {FILINGS}, {_SIZE}, {_WARN} SELECT * FROM warn",
    "stake_events": f"WITH {FILINGS}, {_STAKES.format(where='')} SELECT security, list, kind, count(*) AS n, round(max(pct), 2) AS largest, max(last) AS last FROM se GROUP BY 1, 2, 3",
    "fund_events": f"WITH {DEALS}, {_SIZE}, {_FUNDS} SELECT * FROM fe",
    "pledge_events": f"""WITH {FILINGS}, p AS (SELECT security, person, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS q, max(tax * 1000) AS held, max(day_to) AS day FROM f GROUP BY 1, 2),
        n AS (SELECT security, sum(greatest(least(q, held), -held)) AS net, max(day) AS last FROM p GROUP BY 1)
        SELECT security, CASE WHEN net > 0 THEN 'warn' ELSE 'look' END AS list, CASE WHEN net > 0 THEN 'pledge_created' ELSE 'pledge_released' END AS kind, round(abs(net) / (p_size * 100) * 100, 6) AS pct, last FROM n JOIN part ON p_partkey = security WHERE net <> 0""",
    "today_board": f"""WITH {_IDEAS}, {_WARN}, {_STAKES.format(where=f"WHERE day > DATE '{REF}' - 30 AND day <= DATE '{REF}'")}, {DEALS}, {_FUNDS},
        e AS (SELECT security, 'look' AS list, unnest(kinds) AS kind, pct, value, last FROM look UNION ALL SELECT security, 'warn', kind, pct, value, last FROM warn UNION ALL SELECT security, list, kind, pct, value, last FROM se UNION ALL SELECT security, list, kind, pct, value, last FROM fe),
        g AS (SELECT *, {_ORDER} AS group_order, {_NAME} AS "group" FROM e),
        l AS (SELECT *, row_number() OVER (PARTITION BY security, list ORDER BY group_order, pct DESC NULLS LAST, last DESC NULLS LAST, kind, value DESC NULLS LAST) AS lead FROM g),
        k AS (SELECT security, list, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM e GROUP BY 1, 2),
        r AS (SELECT *, coalesce(value >= {_BIG}::DOUBLE, false) AND row_number() OVER (PARTITION BY list, group_order ORDER BY CASE WHEN value >= {_BIG}::DOUBLE THEN value END DESC NULLS LAST, security) <= 3 AS lifted FROM l WHERE lead = 1)
        SELECT r.list, "group", row_number() OVER (PARTITION BY r.list, group_order ORDER BY lifted DESC, CASE WHEN lifted THEN value ELSE pct END DESC NULLS LAST, last DESC NULLS LAST, r.security)::INT AS place, r.security, kind, pct, value, last, kinds FROM r JOIN k ON k.security = r.security AND k.list = r.list""",
    "company_view": f"""WITH {_IDEAS}, {_WARN}, e AS (SELECT security, 'look' AS list, unnest(kinds) AS kind, pct, value, last FROM look UNION ALL SELECT security, 'warn', kind, pct, value, last FROM warn)
        SELECT security, list, pct, value, last, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM e GROUP BY 1, 2, 3, 4, 5""",
    "float_absorbers": f"""WITH {FILINGS}, {_SIZE}, w AS (SELECT security, person, round(sum(CASE WHEN side = 'BUY' THEN value ELSE 0 END), 2) AS v FROM f WHERE {_WINDOW} GROUP BY 1, 2)
        SELECT w.security, person, round(v / (market_cap * public_pct / 100) * 100, 6) AS float_pct FROM w JOIN z ON z.security = w.security WHERE v / (market_cap * public_pct / 100) * 100 >= 10""",
    "latest_shareholding": "SELECT o_custkey AS who, CAST(o_orderdate AS DATE) AS day, o_orderkey AS id, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1",
    "buys_in_days": f"""WITH {FILINGS}, b AS (SELECT security, person, count(*) FILTER (side = 'BUY') OVER (PARTITION BY security, person ORDER BY day_to RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW) AS buys FROM f)
        SELECT security, person, max(buys) AS most, count(*) AS n FROM b GROUP BY 1, 2""",
    "session_by_company": f"""WITH {FILINGS}, {_SIZE} SELECT f.security, person, side, round(sum(value), 2) AS value, sum(quantity) AS quantity, count(*) AS trades, round(sum(value) / any_value(market_cap) * 100, 6) AS pct, round(sum(value) / (any_value(market_cap) * any_value(public_pct) / 100) * 100, 6) AS float_pct
        FROM f LEFT JOIN z ON z.security = f.security WHERE day_to = DATE '{REF}' GROUP BY 1, 2, 3""",
    "small_cap_accumulation": f"""WITH {DEALS}, {_SIZE}, w AS (SELECT d.security, {_NET.format('round(quantity, 2)')} AS net, any_value(market_cap) AS cap, max(day) AS last FROM d JOIN z ON z.security = d.security WHERE market_cap < 1000000 AND day > DATE '2024-01-31' - 30 AND day <= DATE '2024-01-31' GROUP BY 1)
        SELECT security, round(net, 2) AS net, round(net / cap * 100, 8) AS pct, last FROM w WHERE net > 0""",
    "insider_details": f"""WITH {FILINGS}, w AS (SELECT *, CASE WHEN person % 10 = 0 THEN 'group' WHEN person % 10 < 6 THEN 'officer' ELSE 'other' END AS role FROM f WHERE side = 'BUY' AND {_WINDOW}),
        r AS (SELECT security, string_agg(n || ' ' || role, ', ' ORDER BY role) AS roles FROM (SELECT security, role, count(DISTINCT person) AS n FROM w GROUP BY 1, 2) GROUP BY 1)
        SELECT w.security, count(DISTINCT person) AS persons, count(DISTINCT CASE WHEN role = 'group' THEN 'GROUP' ELSE CAST(person AS VARCHAR) END) AS makers, count(*) AS trades, any_value(roles) AS roles FROM w JOIN r ON r.security = w.security GROUP BY 1""",
    "net_by_manager": f"""WITH {DEALS}, g AS (SELECT 'm' || (client % 5) AS manager, count(DISTINCT client) AS funds, count(DISTINCT CASE WHEN client % 2 = 0 THEN client END) AS sub_advised, round(sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END), 2) AS buy,
        round(sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0 END), 2) AS sell, count(DISTINCT security) AS securities FROM d WHERE client % 5 < 4 GROUP BY 1) SELECT *, round(buy - sell, 2) AS net FROM g""",
    "investors_floored": f"""WITH {FILINGS}, {_SIZE}, p AS (SELECT person, f.security, {_NET.format('value')} AS v, any_value(market_cap) AS cap FROM f JOIN z ON z.security = f.security GROUP BY 1, 2), q AS (SELECT *, round(v / cap * 100, 6) AS p FROM p),
        n AS (SELECT person, round(sum(v), 2) AS net, arg_max(p, {{'a': abs(p), 'b': p}}) AS largest_pct FROM q GROUP BY 1) SELECT * FROM n WHERE abs(net) >= 9000000 OR abs(largest_pct) >= 60""",
    "sector_rollup": f"""WITH {_IDEAS}, {_WARN}, {DEALS}, t AS (SELECT p_partkey AS security, string_split(p_type, ' ')[1] AS sector FROM part),
        s AS (SELECT security, value, 'BUY' AS side FROM look UNION ALL SELECT security, value, 'SELL' FROM warn),
        o AS (SELECT sector, round(sum(CASE WHEN side = 'BUY' THEN value ELSE 0 END), 2) AS bought, round(sum(CASE WHEN side = 'SELL' THEN value ELSE 0 END), 2) AS sold, count(DISTINCT s.security) AS companies, arg_max(s.security, {{'a': value, 'b': -s.security}}) FILTER (side = 'BUY') AS top FROM s JOIN t ON t.security = s.security GROUP BY 1),
        u AS (SELECT sector, round({_NET.format('quantity')}, 2) AS funds_net FROM d JOIN t ON t.security = d.security GROUP BY 1)
        SELECT coalesce(o.sector, u.sector) AS sector, coalesce(bought, 0) AS bought, coalesce(sold, 0) AS sold, coalesce(companies, 0) AS companies, top, coalesce(funds_net, 0) AS funds_net FROM o FULL JOIN u ON o.sector = u.sector""",
    "screener_presets": f"""WITH {FILINGS}, {_SIZE}, g AS (SELECT security, round({_NET.format('value')}, 2) AS net, count(DISTINCT person) AS people, max(day_to) AS last FROM f GROUP BY 1), s AS (SELECT g.*, market_cap, public_pct FROM g LEFT JOIN z ON z.security = g.security)
        SELECT 'net_bought' AS preset, security, net, people, last FROM s WHERE net > 0 UNION ALL SELECT 'many_people', security, net, people, last FROM s WHERE people >= 25
        UNION ALL SELECT 'small', security, net, people, last FROM s WHERE market_cap < 1000000 UNION ALL SELECT 'closely_held', security, net, people, last FROM s WHERE public_pct < 35""",
    "holdings_by_stock": f"""WITH {_MONTHS}, e AS (SELECT min(month) AS lo, max(month) AS hi FROM m),
        c AS (SELECT coalesce(a.house, b.house) AS house, coalesce(a.security, b.security) AS security, coalesce(a.month, b.month + 1) AS month, coalesce(b.shares, 0) AS before, coalesce(a.shares, 0) AS after, a.value FROM m a FULL JOIN m b ON a.house = b.house AND a.security = b.security AND a.month = b.month + 1),
        k AS (SELECT c.* FROM c, e WHERE month BETWEEN lo + 1 AND hi),
        g AS (SELECT month, security, count(*) FILTER (after > before) AS adding, count(*) FILTER (after < before) AS cutting, count(*) FILTER (before = 0 AND after > 0) AS starting, count(*) FILTER (before > 0 AND after = 0) AS leaving, sum(after - before) AS net,
            count(*) FILTER (after > 0) AS holding, sum(CAST(round(value * 100) AS BIGINT)) FILTER (after > 0)::DOUBLE AS v, sum(after) FILTER (after > 0) AS s FROM k GROUP BY 1, 2)
        SELECT month::INT AS month, security, adding, cutting, starting, leaving, round(net, 2) AS net, holding, floor(v / s + 0.5::DOUBLE)::BIGINT AS price_cents, floor(net * (v / s) + 0.5::DOUBLE)::BIGINT AS net_cents FROM g""",
    "first_held": f"WITH {_MONTHS}, x AS (SELECT security, min(month)::INT AS month FROM m GROUP BY 1) SELECT * FROM x WHERE month > (SELECT min(month) FROM m)",
    "renamed_securities": f"""WITH {FILINGS}, h AS (SELECT DISTINCT c_nationkey AS house, security, concat_ws(' ', p_type, p_size) AS name, year(day_from) AS year FROM f JOIN customer ON c_custkey = second JOIN part ON p_partkey = security),
        o AS (SELECT house, name, min(security) AS old FROM h WHERE year = 1996 AND NOT EXISTS (SELECT 1 FROM h n WHERE n.year = 1997 AND n.house = h.house AND n.security = h.security) GROUP BY 1, 2 HAVING count(*) = 1),
        w AS (SELECT house, name, min(security) AS new FROM h WHERE year = 1997 AND NOT EXISTS (SELECT 1 FROM h n WHERE n.year = 1996 AND n.house = h.house AND n.security = h.security) GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT old, min(new) AS new FROM o JOIN w ON o.house = w.house AND o.name = w.name GROUP BY 1 HAVING count(DISTINCT new) = 1""",
    "fund_rollup": f"""WITH {DEALS}, n AS (SELECT security, round({_NET.format('quantity')}, 4) AS net FROM d GROUP BY 1)
        SELECT coalesce(p_brand, 'Not classified') AS label, round(sum(net), 2) AS net, count(DISTINCT security) AS securities, round(sum(greatest(net, 0.0)), 2) AS bought, round(sum(least(net, 0.0)), 2) AS sold FROM n LEFT JOIN part ON p_partkey = security AND p_size > 5 WHERE net IS NOT NULL GROUP BY 1""",
    "bucket_rollup": f"""WITH {DEALS}, n AS (SELECT security, round({_NET.format('quantity')}, 4) AS net FROM d GROUP BY 1)
        SELECT CASE WHEN p_partkey IS NULL THEN 'No size' WHEN p_retailprice > 1200 THEN 'Large' WHEN p_retailprice > 1000 THEN 'Mid' ELSE 'Small' END AS bucket, round(sum(net), 2) AS net_value, count(*) FILTER (net > 0) AS bought, count(*) FILTER (net < 0) AS sold, count(DISTINCT security) AS securities
        FROM n LEFT JOIN part ON p_partkey = security AND p_size > 5 GROUP BY 1""",
    "expected_factors": f"WITH {_ACTIONS} SELECT security, ex_day, round(expected, 8) AS expected, split_bonus FROM x",
    "share_factors": f"WITH {_ACTIONS} SELECT security, round(1 / exp(sum(ln(expected))), 6) AS factor FROM x WHERE split_bonus AND expected > 0 AND ex_day > DATE '1997-01-31' AND ex_day <= DATE '1997-02-28' GROUP BY 1",
    "clean_ratios": f"""WITH {BARS}, r AS (SELECT k::DOUBLE AS q FROM range(2, 21) t(k) UNION SELECT 1 / k::DOUBLE FROM range(2, 21) t(k) UNION SELECT a / (a + b)::DOUBLE FROM range(1, 6) x(a), range(1, 6) y(b)
        UNION SELECT h / (h + n)::DOUBLE FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 10]) AS h) x, range(1, 12) y(n) WHERE n <= h + 1), x AS (SELECT round(low / high, 6) AS f FROM b)
        SELECT coalesce((SELECT bool_or(abs(f / q - 1) <= 0.015::DOUBLE) FROM r), false) AS clean, count(*) AS n FROM x GROUP BY 1""",
    "basket_nav": f"""WITH {FILINGS}, {BARS}, p AS (SELECT security, min(day_to) AS entry_day, CASE WHEN max(day_to) > min(day_to) THEN max(day_to) END AS exit_day FROM f WHERE side = 'BUY' GROUP BY 1),
        mv AS (SELECT security, day, (close / lag(close) OVER (PARTITION BY security ORDER BY day) - 1) * 100 AS move FROM b), dd AS (SELECT DISTINCT day FROM b WHERE day >= (SELECT min(entry_day) FROM p)),
        o AS (SELECT day, avg(move) AS gain, count(*) AS live FROM mv JOIN p ON p.security = mv.security AND day > entry_day AND (exit_day IS NULL OR day <= exit_day) GROUP BY 1), n AS (SELECT entry_day AS day, count(*) AS entering FROM p GROUP BY 1),
        q AS (SELECT dd.day, coalesce(gain, 0) AS gain, coalesce(live, 0) AS live, coalesce(entering, 0) AS entering FROM dd LEFT JOIN o ON o.day = dd.day LEFT JOIN n ON n.day = dd.day), y AS (SELECT day, live + entering AS held, gain - CASE WHEN live + entering > 0 THEN 0.25::DOUBLE * entering / (live + entering) ELSE 0 END AS mean_return FROM q)
        SELECT day, held AS open_positions, round(mean_return, 6) AS mean_return, round(100 * exp(sum(ln(1 + mean_return / 100)) OVER (ORDER BY day)), 4) AS nav FROM y""",
}
