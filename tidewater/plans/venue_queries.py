"""Queries on what two exchanges say of one thing: transfers and placements by their deals, disclosures and meetings on both, files' standings, events of capital, and results by quarter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.bindings import FILINGS, REF, filings, ref
from tidewater.operators import capital, results, transfers, venues
from tidewater.sources.files import table
from tidewater.streaming import retries

# Roles by line number; the two later roles of the sample are no insiders.
ROLES = ["promoter", "promoter", "promoter_group", "director", "kmp"]


def _trades(spark, folder):
    """Line items as insiders' trades over up to four weeks in four companies."""
    role = F.coalesce(F.get(F.array(*map(F.lit, ROLES)), F.col("line").cast("int") - 1), F.lit("employee"))
    days = (F.col("order_id") % 28).cast("int")
    return filings(spark, folder).select(
        "order_id", "line", (F.col("security") % 4).cast("string").alias("security"), "quantity", "side", F.when(F.col("tax") > 0.01, "market").otherwise("off_market").alias("kind"), role.alias("role"),
        F.when(F.col("order_id") % 9 > 0, F.date_sub("day_to", days)).alias("day_from"), "day_to", (F.col("tax") > 0.01).alias("is_market"),
    )


def _deals(spark, folder):
    """Orders as deals: the customer buys in the week of the order what the next customer sells; every second is a pair, of which some lack a side."""
    o = table(spark, folder, "orders")
    key, buyer = F.col("o_orderkey"), F.col("o_custkey")
    sides = F.array_compact(F.array(F.lit("BUY"), F.when(key % 10 != 1, "SELL")))
    legs = o.withColumn("side", F.explode(sides))
    client = F.when(F.col("side") == "BUY", buyer).otherwise(buyer + 1)
    return legs.select(
        (key * 2 + F.when(F.col("side") == "BUY", 0).otherwise(1)).alias("deal_id"), F.when(key % 2 == 1, key).alias("pair"), (buyer % 4).cast("string").alias("security"), F.trunc(F.col("o_orderdate").cast("date"), "week").alias("day"), (key % 50 + 1).cast("double").alias("quantity"),
        (F.lit(100.0) + (key % 5) * 0.03).alias("price"), "side", F.concat(F.lit("C"), client.cast("string")).alias("client_name"), (client % 3 > 0).alias("client_is_promoter"),
    )


def insider_transfers(spark, folder):
    """Trades marked by the exchange's pairs and placements."""
    marked = transfers.insider_transfers(_trades(spark, folder), _deals(spark, folder))
    return marked.select("order_id", "line", "kind", "is_market", "cross_with", "group_transfer_by_deal", F.array_join("placement_buyers", ";").alias("placement_buyers"))


def two_venue_stakes(spark, folder):
    """Stakes told to the second exchange (lines from the fourth on) and the first (lines to the fourth), linked by company, day, direction and about the same shares."""
    rows = filings(spark, folder).select((F.col("order_id") * 8 + F.col("line")).alias("event_id"), "line", (F.col("security") % 10).alias("isin"), F.col("day_to").alias("day"), F.col("side").alias("direction"), (F.col("quantity") * F.col("person")).alias("shares"))
    linked = venues.linked_to_first(rows.where("line >= 4"), rows.where("line <= 4"), ["isin", "day", "direction"], "event_id", "shares")
    return linked.select("event_id", "shares", "on_first", "first_event_id", "listed_on")


def two_venue_meetings(spark, folder):
    """Orders as board meetings of fifty companies: the moved go, the rest are linked by company and day, and the second exchange's own join the first's."""
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    told = F.when(key % 11 > 0, F.date_sub(day, (key % 30).cast("int")))
    rows = table(spark, folder, "orders").select(key.alias("event_id"), (F.col("o_custkey") % 50).alias("code"), day.alias("day"), told.alias("intimated"), (key % 5 == 0).alias("moved"))
    second = venues.without_moved(rows.where("event_id % 2 = 1")).where("reason is null").drop("reason")
    first = rows.where("event_id % 2 = 0")
    return venues.of_both(first, venues.linked_to_first(second, first, ["code", "day"], "event_id")).select("event_id", "code", "day", "listed_on")


def file_standings(spark, folder):
    """Events as sights and tries of their users' files."""
    e = table(spark, folder, "events")
    status = F.when(F.col("event_id") % 17 == 0, "ok").when(F.col("event_id") % 3 > 0, "failed")
    reason = F.when(F.col("event_id") % 13 == 0, "HTTP 410").otherwise("timeout")
    sights = e.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("file_id"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), reason.alias("reason"))
    out = retries.retry_table(sights)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("file_id", text("first_seen"), text("last_seen"), "tries", "status", text("due_at"))


def capital_events(spark, folder):
    """All events of capital in the window: line items as deals (tax over 4 %), filings (none), issues, raises (by line) and buybacks of their parts."""
    f = filings(spark, folder, finer=True)
    shares = table(spark, folder, "part").select(F.col("p_partkey").alias("security"), F.when(F.col("p_size") % 10 > 0, F.col("p_size") * 40.0).alias("total"))
    by_line = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("line") % 3 + 1).cast("int"))
    shown = f.select("*", (F.col("quantity") - 25).alias("vs_market"), F.when(F.col("line") % 2 == 0, F.col("quantity")).alias("allotted"), (F.col("quantity") * 2).alias("proposed"), F.col("value").alias("amount"), F.col("order_id").alias("app_id"))
    parts = capital.promoter_parts(f.select(F.col("order_id").alias("app_id"), F.col("quantity").alias("securities"), (F.col("person") % 2 == 0).alias("in_promoter_group")))
    raises = shown.select("security", by_line("preferential", "qip", "rights").alias("source"), F.when(F.col("side") == "BUY", "Allotted or listed").otherwise("Approved").alias("status"), F.when(F.col("person") % 2 == 0, "PROMOTER").otherwise("MIXED").alias("category"), F.when(F.col("line") > 2, F.col("day_to")).alias("allotted_on"), F.col("day_from").alias("posted_on"), (F.col("amount") * 20_000).alias("amount"), "allotted")
    buybacks = f.select("security", F.when(F.col("line") % 2 == 0, "tender").otherwise("open market").alias("route"), (F.col("discount") * 200).alias("vs_market"), F.col("quantity").alias("sought"), F.col("value").alias("offer_value"), F.when(F.col("line") > 2, F.col("day_to")).alias("opens"), F.col("day_from").alias("record_day"))
    events = [
        capital.promoter_deal_events(f.where("tax > 0.04").withColumn("day", F.col("day_to")), f.where("tax < 0.01").select("security", F.col("day_from").alias("day")), shares, ref()),
        capital.issue_events(shown.select("app_id", "security", by_line("PROMOTER", "MIXED", "NON_PROMOTER").alias("category"), "vs_market", "allotted", "proposed", "amount", F.col("day_to").alias("day")), parts, shares, ref()),
        capital.raise_events(raises, shares, ref()), capital.buyback_events(buybacks, shares, ref()),
    ]
    both = events[0]
    for more in events[1:]:
        both = both.unionByName(more)
    return both.withColumns({"pct": F.round("pct", 5), "value": F.round("value", 3)})


def results_kpis(spark, folder):
    """Orders as results filings: the figures of each quarter and priority."""
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, folder, "orders").select(
        F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter"), F.col("o_orderpriority").alias("sector"), F.col("o_custkey").alias("security"), F.when(key % 13 == 0, "far").alias("doubt"), (key % 10 == 0).alias("half"), F.when(key % 17 > 0, total * 1000).alias("revenue"),
        F.when(key % 7 > 0, (key % 41 - 20).cast("double")).alias("revenue_growth"), (total - 100_000).alias("profit"), F.when(key % 3 > 0, (key % 200 - 50).cast("double")).alias("profit_before"),
    )
    out = results.kpis(results.compared(rows), ["quarter", "sector"])
    return out.withColumns({c: F.round(c, 5) for c in ("revenue_median", "profit_median")})


QUERIES = {"results_kpis": results_kpis, "capital_events": capital_events, "insider_transfers": insider_transfers, "two_venue_stakes": two_venue_stakes, "two_venue_meetings": two_venue_meetings, "file_standings": file_standings}

_WINDOW = f"<= DATE '{REF}' + 1 AND {{0}} > DATE '{REF}' - 90"

ORACLE_SQL = {
    "results_kpis": """WITH r AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS quarter, o_orderpriority AS sector, o_custkey AS security, o_orderkey % 13 = 0 AS held, o_orderkey % 10 = 0 AS h, o_orderkey % 17 = 0 AS bare, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 41 - 20)::DOUBLE END AS g,
            o_totalprice - 100000 AS p, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 200 - 50)::DOUBLE END AS b FROM orders),
        x AS (SELECT *, NOT held AND NOT h AS c, CASE WHEN b > 0 THEN (p / b - 1) * 100 END AS pg FROM r)
        SELECT quarter, sector, count(DISTINCT security) AS reported, count(*) FILTER (held) AS held, count(*) FILTER (NOT held AND h) AS half, count(g) FILTER (c) AS revenue_n, count(*) FILTER (c AND g > 0) AS revenue_up, count(pg) FILTER (c) AS profit_n, count(*) FILTER (c AND pg > 0) AS profit_up,
            count(*) FILTER (c AND b < 0 AND p >= 0) AS to_profit, count(*) FILTER (c AND b >= 0 AND p < 0) AS to_loss, count(*) FILTER (c AND bare) AS no_revenue, round(median(g) FILTER (c), 5) AS revenue_median, round(median(pg) FILTER (c), 5) AS profit_median FROM x GROUP BY 1, 2""",
    "capital_events": f"""WITH {FILINGS}, sh AS (SELECT p_partkey AS security, CASE WHEN p_size % 10 > 0 THEN p_size * 40.0::DOUBLE END AS total FROM part),
        n AS (SELECT security, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS net, sum(CASE WHEN side = 'BUY' THEN value ELSE -value END) AS worth, max(day_to) AS l FROM f WHERE tax > 0.04 AND day_to <= DATE '{REF}' AND day_to > DATE '{REF}' - 90
            AND security NOT IN (SELECT security FROM f WHERE tax < 0.01 AND day_from {_WINDOW.format("day_from")}) GROUP BY 1),
        pa AS (SELECT order_id, sum(quantity) FILTER (person % 2 = 0) / sum(quantity) AS part, count(*) FILTER (person % 2 = 0) AS members FROM f GROUP BY 1),
        i AS (SELECT f.*, line % 3 = 1 AS mixed, quantity * CASE WHEN line % 2 = 0 THEN 1 ELSE 2 END AS shares FROM f WHERE line % 3 < 2 AND day_to {_WINDOW.format("day_to")}),
        r AS (SELECT *, (['preferential', 'qip', 'rights'])[line % 3 + 1] AS source, CASE WHEN line > 2 THEN day_to ELSE day_from END AS day, value * 20000 AS amount, CASE WHEN line % 2 = 0 THEN quantity END AS allotted FROM f WHERE side = 'BUY'),
        r1 AS (SELECT r.*, CASE WHEN allotted > 0 AND allotted < total * 0.5::DOUBLE THEN allotted / total * 100 END AS dil FROM r LEFT JOIN sh USING (security) WHERE (source <> 'preferential' OR person % 2 <> 0) AND day {_WINDOW.format("day")}),
        b AS (SELECT *, CASE WHEN line > 2 THEN day_to ELSE day_from END AS day FROM f WHERE line % 2 = 0 AND discount * 200 >= 10),
        e AS (SELECT security, CASE WHEN net > 0 THEN 'look' ELSE 'warn' END AS "list", CASE WHEN net > 0 THEN 'promoter_deal_buy' ELSE 'promoter_deal_sale' END AS kind, abs(net) / total * 100 AS pct, abs(worth) AS value, l AS "last" FROM n JOIN sh USING (security) WHERE abs(net) / total * 100 >= 0.05
            UNION ALL SELECT i.security, CASE WHEN quantity >= 25 THEN 'look' ELSE 'warn' END, CASE WHEN quantity >= 25 THEN 'promoters_pay_up' ELSE 'cheap_shares_to_promoters' END, coalesce(shares / total * 100, 0) * CASE WHEN mixed THEN coalesce(part, 1) ELSE 1 END, value, day_to FROM i LEFT JOIN sh USING (security) LEFT JOIN pa USING (order_id) WHERE NOT (mixed AND coalesce(members = 0, false))
            UNION ALL SELECT security, 'look', 'raise_' || source, coalesce(dil, 0), CASE WHEN amount > 0 THEN amount END, day FROM r1 WHERE coalesce(amount >= 1e9::DOUBLE, false) OR coalesce(dil >= 2, false)
            UNION ALL SELECT security, 'look', 'buyback_at_premium', coalesce(quantity / total * 100, 0), value, day FROM b LEFT JOIN sh USING (security) WHERE day > DATE '{REF}' - 90)
        SELECT security, "list", kind, round(pct, 5) AS pct, round(value, 3) AS value, "last" FROM e""",
    "insider_transfers": f"""WITH {FILINGS}, t AS (SELECT row_number() OVER () AS n, order_id, line, (security % 4)::VARCHAR AS security, quantity, side, CASE WHEN tax > 0.01 THEN 'market' ELSE 'off_market' END AS kind, coalesce((['promoter', 'promoter', 'promoter_group', 'director', 'kmp'])[line], 'employee') AS role,
            CASE WHEN order_id % 9 > 0 THEN day_to - (order_id % 28)::INT ELSE day_to END AS a, day_to AS b FROM f),
        d AS (SELECT o_orderkey * 2 + (s = 'SELL')::INT AS deal_id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END AS pair, (o_custkey % 4)::VARCHAR AS security, date_trunc('week', o_orderdate)::DATE AS day, (o_orderkey % 50 + 1)::DOUBLE AS quantity, 100.0::DOUBLE + (o_orderkey % 5) * 0.03::DOUBLE AS price, s AS side,
            'C' || (o_custkey + (s = 'SELL')::INT) AS client, (o_custkey + (s = 'SELL')::INT) % 3 > 0 AS prom FROM (SELECT *, unnest(CASE WHEN o_orderkey % 10 <> 1 THEN ['BUY', 'SELL'] ELSE ['BUY'] END) AS s FROM orders)),
        p AS (SELECT b.pair, b.security, b.quantity, b.day, b.client AS buyer, s.client AS seller, b.prom AND s.prom AS inside FROM d b JOIN d s ON b.pair = s.pair AND b.side = 'BUY' AND s.side = 'SELL'),
        m AS (SELECT t.n, t.role, t.side, p.* FROM t JOIN p ON t.security = p.security AND t.quantity = p.quantity AND p.day BETWEEN a AND b WHERE kind = 'market' AND role <> 'employee'),
        c AS (SELECT n, arg_max(CASE WHEN side = 'SELL' THEN buyer ELSE seller END, (day, pair)) AS cross_with FROM m GROUP BY 1),
        k AS (SELECT security, quantity, day FROM m GROUP BY ALL HAVING bool_or(role NOT LIKE 'promoter%')),
        g AS (SELECT DISTINCT n FROM m WHERE inside AND role LIKE 'promoter%' AND (security, quantity, day) NOT IN (SELECT (security, quantity, day) FROM k)),
        z AS (SELECT s.deal_id, s.security, s.quantity, s.day, string_agg(DISTINCT b.client, ';' ORDER BY b.client) AS names FROM d s JOIN d b ON s.side = 'SELL' AND s.prom AND b.side = 'BUY' AND NOT b.prom AND s.security = b.security AND s.day = b.day AND abs(b.price - s.price) <= 0.0005::DOUBLE * s.price GROUP BY ALL HAVING count(*) >= 2),
        q AS (SELECT t.n, arg_max(z.names, (z.day, z.deal_id)) AS names FROM t JOIN z ON t.security = z.security AND t.quantity = z.quantity AND z.day BETWEEN a AND b WHERE kind = 'market' AND side = 'SELL' AND role LIKE 'promoter%' AND n NOT IN (SELECT n FROM c) GROUP BY 1)
        SELECT order_id, line, CASE WHEN g.n IS NOT NULL THEN 'inter_se' ELSE kind END AS kind, kind = 'market' AND g.n IS NULL AS is_market, cross_with, g.n IS NOT NULL AS group_transfer_by_deal, names AS placement_buyers FROM t LEFT JOIN c USING (n) LEFT JOIN g USING (n) LEFT JOIN q USING (n)""",
    "two_venue_stakes": f"""WITH {FILINGS}, r AS (SELECT order_id * 8 + line AS event_id, line, security % 10 AS isin, day_to AS day, side, quantity * person AS shares FROM f),
        x AS (SELECT s.isin, s.day, s.side, s.shares, min(r.event_id) AS first_event_id FROM r s JOIN r ON s.line >= 4 AND r.line <= 4 AND s.isin = r.isin AND s.day = r.day AND s.side = r.side AND abs(s.shares - r.shares) <= greatest(0.01::DOUBLE * abs(r.shares), 1) GROUP BY ALL)
        SELECT s.event_id, s.shares, first_event_id IS NOT NULL AS on_first, first_event_id, CASE WHEN first_event_id IS NULL THEN 'second' ELSE 'second,first' END AS listed_on FROM (SELECT event_id, shares, isin, day, side FROM r WHERE line >= 4) s
        LEFT JOIN x ON x.isin = s.isin AND x.day = s.day AND x.side = s.side AND x.shares = s.shares""",
    "two_venue_meetings": """WITH r AS (SELECT o_orderkey AS event_id, o_custkey % 50 AS code, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate::DATE - (o_orderkey % 30)::INT END AS intimated, o_orderkey % 5 = 0 AS moved FROM orders),
        mv AS (SELECT code, day, max(intimated) AS moved_at FROM r WHERE moved AND event_id % 2 = 1 GROUP BY 1, 2),
        s AS (SELECT r.* FROM r LEFT JOIN mv USING (code, day) WHERE event_id % 2 = 1 AND NOT moved AND NOT (moved_at IS NOT NULL AND coalesce(intimated <= moved_at, true)))
        SELECT event_id, code, day, 'first' AS listed_on FROM r WHERE event_id % 2 = 0 UNION ALL SELECT event_id, code, day, 'second' FROM s WHERE (code, day) NOT IN (SELECT (code, day) FROM r WHERE event_id % 2 = 0)""",
    "file_standings": """WITH e AS (SELECT user_id || ':' || event_type AS file_id, ts, CASE WHEN event_id % 17 = 0 THEN 'ok' WHEN event_id % 3 > 0 THEN 'failed' END AS st, event_id % 13 = 0 AS gone FROM events),
        g AS (SELECT file_id, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT ts) FILTER (st IS NOT NULL)::INT AS tries, bool_or(coalesce(st = 'ok', false)) AS done, bool_or(coalesce(st = 'failed' AND gone, false)) AS dead, max(ts) FILTER (st IS NOT NULL) AS tried FROM e GROUP BY 1),
        s AS (SELECT *, CASE WHEN done THEN 'done' WHEN dead THEN 'gone' WHEN tries >= 3 THEN 'given_up' WHEN tries > 0 THEN 'failed' ELSE 'new' END AS status FROM g)
        SELECT file_id, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, tries, status, CASE WHEN status = 'failed' THEN strftime(tried + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') END AS due_at FROM s""",
}
