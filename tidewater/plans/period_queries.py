"""Queries on periods, linkage, archives, quality and streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.bindings import DEALS, FILINGS, deals, filings
from tidewater.functions import values
from tidewater.operators import archive, linkage, periods, quality, trades
from tidewater.sources.files import table
from tidewater.streaming import windows


def _orders(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("date").alias("day"), F.round("o_totalprice", 2).alias("amount"), F.col("o_orderpriority").alias("priority"))


def period_changes_all(spark, folder):
    """Each quarter of all years with the quarter before it."""
    number = (F.year("day") * 4 + F.quarter("day") - 1).cast("int")
    by = _orders(spark, folder).groupBy("who", number.alias("n")).agg(F.round(F.sum("amount"), 2).alias("amount"))
    quarter = F.make_date(F.floor(F.col("n") / 4).cast("int"), F.col("n") % 4 * 3 + 1, F.lit(1))
    return periods.successive_changes(by, ["who"], "n", "amount").select("who", quarter.alias("quarter"), "before", "after", F.round("change", 2).alias("change"), "kind")


def stock_months(spark, folder):
    o = _orders(spark, folder)
    return o.groupBy(F.trunc("day", "month").alias("month"), "priority").agg(F.count_distinct("who").alias("holders"), F.round(F.sum("amount"), 2).alias("amount"))


def month_prices(spark, folder):
    o = _orders(spark, folder)
    m = o.groupBy("who", F.trunc("day", "month").alias("month")).agg(F.max(F.when(F.col("priority") == "1-URGENT", F.col("amount"))).alias("price"))
    return periods.filled_forward(m, ["who"], ["month"], "price", "carried")


def holders_latest_vs_prev(spark, folder):
    o = _orders(spark, folder).groupBy("who", F.trunc("day", "quarter").alias("quarter")).agg(F.round(F.sum("amount"), 2).alias("amount"))
    out = periods.latest_with_previous(o, "who", "quarter", "amount")
    near = periods.change_if_near(F.col("amount"), F.col("previous"), F.col("quarter"), F.col("previous_period"))
    return out.select("who", "quarter", "amount", "previous", F.round(near, 2).alias("change"))


def latest_n_dates(spark, folder):
    return periods.latest_dates(_orders(spark, folder), "who", "day", 2).groupBy("who", "nth").agg(F.count("*").alias("n"), F.max("day").alias("day"))


def derive_quarters(spark, folder):
    o = _orders(spark, folder).select("who", F.year("day").alias("year"), F.quarter("day").alias("quarter"), "amount")
    per = o.groupBy("who", "year", "quarter").agg(F.sum("amount").alias("q"))
    from pyspark.sql import Window

    ytd = per.withColumn("ytd", F.round(F.sum("q").over(Window.partitionBy("who", "year").orderBy("quarter")), 2))
    return periods.derived_from_year_to_date(ytd, "who", "year", "quarter", "ytd").select("who", "year", "quarter", "ytd", F.round("derived", 2).alias("derived"))


def growth_yoy(spark, folder):
    o = _orders(spark, folder).groupBy("who", F.year("day").alias("year")).agg(F.round(F.sum("amount"), 2).alias("amount"))
    return periods.year_on_year(o, ["who"], "year", "amount").select("who", "year", "amount", "year_ago", F.round("growth_pct", 4).alias("growth_pct"))


def weekly_bins(spark, folder):
    d = deals(spark, folder)
    last = d.agg(F.max("day")).first()[0]
    out = periods.trailing_bins(d, "day", F.lit(last), 7, 4, "quantity")
    return out.select("bin", "n", F.round("total", 2).alias("total"))


def month_to_date(spark, folder):
    o = _orders(spark, folder).where("dayofmonth(day) <= 15")
    m = o.groupBy(F.trunc("day", "month").alias("month")).agg(F.round(F.sum("amount"), 2).alias("to_date"))
    from pyspark.sql import Window

    return m.withColumn("before", F.lag("to_date").over(Window.orderBy("month")))


def daily_net_calendar_all(spark, folder):
    """Every day from the first deal to the last, Sundays with their deals."""
    return periods.daily_calendar(deals(spark, folder), "day", None, None, F.round(F.sum(trades.signed("side", "quantity")), 2))


def sector_pivot_all(spark, folder):
    o = _orders(spark, folder).select("who", F.substring("priority", 1, 1).alias("p"), F.lit(1).cast("long").alias("one"))
    return periods.pivot_sums(o, "who", "p", ["1", "2", "3", "4", "5"], "one").select("who", *[F.col(p).alias(f"p{p}") for p in "12345"])


def unbroken_since(spark, folder):
    d = deals(spark, folder).select("client", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("number"))
    return periods.unbroken_since(d, "client", "number")


def session_window_30m(spark, folder):
    return periods.sessions_by_gap(deals(spark, folder), "client", "ts", "event_id", 30).select("client", "start", "end", "n")


def window_tumbling(spark, folder):
    out = windows.tumbling(deals(spark, folder), "ts", "6 hours", ["event_type"], "quantity")
    return out.select("start", "event_type", "n", F.round("total", 2).alias("total"))


def session_window_stream(spark, folder):
    return windows.gap_sessions(deals(spark, folder), "ts", "2 hours", "client").select("client", "start", "n")


def dedup_within_window(spark, folder):
    d = deals(spark, folder).select("client", F.date_trunc("hour", "ts").alias("hour"))
    return windows.once(d, "hour", ["client", "hour"]).groupBy("client").agg(F.count("*").alias("hours"))


def crossings(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("who"), (F.col("c_acctbal") / 100).alias("after"), F.col("c_nationkey").cast("double").alias("before"))
    out = c.select("who", F.explode(values.crossed(F.col("before"), F.col("after"), (5, 10, 15, 20, 25, 50, 75))).alias("threshold"), (F.col("after") > F.col("before")).alias("up"))
    return out.groupBy("threshold", "up").agg(F.count("*").alias("n"))


def fiscal_quarters(spark, folder):
    return _orders(spark, folder).groupBy(values.fiscal_quarter(F.col("day")).alias("fq")).agg(F.count("*").alias("n"))


def archive_merge_upsert(spark, folder):
    d = deals(spark, folder).select("client", "event_type", "day", F.round("quantity", 2).alias("quantity"), "event_id")
    key = ["client", "event_type"]
    newest = [F.desc("event_id")]
    old = archive.last_per_key(d.where("day <= date'2024-01-15'"), key, *newest).withColumns({"first_seen": F.col("day"), "last_seen": F.lit("2024-01-15").cast("date")})
    new = archive.last_per_key(d.where("day > date'2024-01-15'"), key, *newest).withColumn("quantity", F.when(F.col("event_id") % 3 != 0, F.col("quantity")))
    return archive.merge(old, new, key, F.lit("2024-01-30").cast("date"), lossless=["quantity"])


def archive_backfill(spark, folder):
    d = deals(spark, folder).select("client", "event_type", F.round("quantity", 2).alias("quantity"), "event_id")
    key = ["client", "event_type"]
    old = archive.last_per_key(d.where("event_id % 2 = 0"), key, F.desc("event_id")).withColumn("quantity", F.when(F.col("event_id") % 3 != 0, F.col("quantity")))
    new = archive.last_per_key(d.where("event_id % 2 = 1"), key, F.desc("event_id"))
    return archive.backfill(old, new, key, ["quantity"])


def possibly_withdrawn(spark, folder):
    d = deals(spark, folder).groupBy("client", "day").agg(F.count("*").alias("n")).withColumn("last_seen", F.date_add("day", (F.col("client") % 5).cast("int")))
    return archive.possibly_withdrawn(d, "day", F.lit("2024-01-30").cast("date"), 7).select("client", "day", "n")


def pending_retries(spark, folder):
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").alias("who"))
    tried = _orders(spark, folder).groupBy("who").agg(F.count("*").alias("tries"), F.max("priority").alias("p")).select("who", (F.col("p") == "1-URGENT").alias("done"), "tries")
    return archive.pending(wanted, tried, "who", 8)


def due_next(spark, folder):
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").alias("who"))
    fetched = _orders(spark, folder).groupBy("who").agg(F.max("day").alias("fetched"))
    return archive.due(wanted, fetched, "who", F.lit("2001-08-01").cast("date"), 30, 40)


def asof_market_cap(spark, folder):
    left = filings(spark, folder).select("order_id", "line", "second", "day_to", "value").withColumn("who", F.col("second")).drop("second")
    right = _orders(spark, folder).select("who", "day", "amount")
    out = linkage.asof_join(left, right, ["who"], "day_to", "day", ["amount"])
    return out.groupBy("who").agg(F.count("*").alias("n"), F.count("amount").alias("matched"), F.round(F.sum("amount"), 2).alias("amount"))


def _deal_asof(spark, folder, **how):
    d = deals(spark, folder)
    lo = d.agg(F.min("event_type")).first()[0]
    right = d.where(F.col("event_type") == lo).select("client", "day", F.round("quantity", 2).alias("price"))
    left = d.where(F.col("event_type") != lo).select("event_id", "client", F.col("day").alias("asked"))
    return linkage.asof_join(left, right, ["client"], "asked", "day", ["price"], **how).select("event_id", "client", "asked", "price", "matched_time")


def asof_tolerance(spark, folder):
    return _deal_asof(spark, folder, tolerance_days=2)


def asof_strict(spark, folder):
    return _deal_asof(spark, folder, strict=True)


def asof_forward(spark, folder):
    return _deal_asof(spark, folder, direction="forward")


def asof_nearest(spark, folder):
    return _deal_asof(spark, folder, direction="nearest")


def matched_pairs(spark, folder):
    d = deals(spark, folder)
    buys, sells = (d.where(F.col("side") == side).select("event_id", "security", "day", "client", "quantity") for side in ("BUY", "SELL"))
    # a row's nearest candidates tell whether it has only one: no pairs are made, however many amounts a day has
    return linkage.only_near(buys, sells, ["security", "day"], "quantity", "client", "event_id", "buy_id", "sell_id", 0.2)


def pair_copies_ranked(spark, folder):
    d = deals(spark, folder)
    a = d.where("side = 'BUY'").select("client", "day", F.col("event_id").alias("left_id"))
    b = d.where("side = 'SELL'").select("client", "day", F.col("event_id").alias("right_id"))
    return linkage.ranked_pairs(a, b, ["client", "day"], ["left_id"], ["right_id"]).select("client", "day", "left_id", "right_id")


def stage_link_status(spark, folder):
    o = _orders(spark, folder)
    later = o.where("priority = '5-LOW'").select("who", F.col("id").alias("later_id"), F.col("day").alias("later_day"))
    early = o.where("priority = '1-URGENT'").select("who", F.col("id").alias("earlier_id"), F.col("day").alias("earlier_day"))
    return linkage.link_stages(later, early, "who", "later_id", "later_day", "earlier_id", "earlier_day")


def deals_also_filed_all(spark, folder):
    """Orders against the spans of any length of their own customer."""
    f = filings(spark, folder).select(F.col("second").alias("who"), "day_from", "day_to")
    out = linkage.exists_in_span(_orders(spark, folder), f, ["who"], "day", "day_from", "day_to")
    return out.groupBy("who", "in_span").agg(F.count("*").alias("n"))


def unmatched_prefix_resolve(spark, folder):
    s = table(spark, folder, "supplier").select(F.lower("s_name").alias("full"), F.col("s_suppkey").alias("code"))
    names = s.select(F.expr("substring(full, 1, length(full) - 1)").alias("name")).unionByName(s.select(F.col("full").alias("name")))
    return linkage.unique_prefix(names, s, "name", "full", "code")


def resolve_cascade(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    o = _orders(spark, folder).select("id", (F.col("who") % 300).alias("code"), (F.col("who") % 25).cast("int").alias("nation"))
    out = linkage.cascade(o, [(s.where("code <= 50"), "code", "code", "name"), (s, "nation", "nation", "name")], "resolved")
    return out.groupBy("resolved_by").agg(F.count("*").alias("n"), F.count("resolved").alias("named"))


def unit_checks(spark, folder):
    f = filings(spark, folder)
    return quality.percent_checks(f, ["tax", "discount", "quantity"], 0.0, 45.0)


def coverage_status(spark, folder):
    o = _orders(spark, folder).select("who").distinct()
    c = table(spark, folder, "customer").select((F.col("c_custkey") + 3).alias("who"))
    return quality.coverage(o, c, ["who"])


def add_up(spark, folder):
    parts = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"))
    wholes = _orders(spark, folder).select("id", "amount")
    out = quality.add_up(parts, wholes, ["id"], "amount", 100_000)
    return out.select("id", F.round("parts", 2).alias("parts"), "whole")


def data_health(spark, folder):
    tables = {n: (table(spark, folder, n), c) for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))}
    return quality.freshness(tables)


def differing_fields(spark, folder):
    f = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_returnflag", F.row_number().over(_first()).alias("at"))
    keys, fields = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_tax", "l_returnflag"]
    return quality.differing_fields(f.where("at = 1").drop("at"), f.where("at > 1").drop("at"), keys, fields)


def _first():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_tax", "l_returnflag")


QUERIES = {f.__name__: f for f in (period_changes_all, stock_months, month_prices, holders_latest_vs_prev, latest_n_dates, derive_quarters, growth_yoy, weekly_bins, month_to_date, daily_net_calendar_all, sector_pivot_all, unbroken_since, session_window_30m, window_tumbling, session_window_stream, dedup_within_window, crossings, fiscal_quarters, archive_merge_upsert, archive_backfill, possibly_withdrawn, pending_retries, due_next, asof_market_cap, asof_tolerance, asof_strict, asof_forward, asof_nearest, matched_pairs, pair_copies_ranked, stage_link_status, deals_also_filed_all, unmatched_prefix_resolve, resolve_cascade, unit_checks, coverage_status, add_up, data_health, differing_fields)}

_O = "o AS (SELECT o_orderkey AS id, o_custkey AS who, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS amount, o_orderpriority AS priority FROM orders)"
_DR = f"""{DEALS}, t AS (SELECT min(event_type) AS lo FROM d), r AS (SELECT client, day, max(round(quantity, 2)) AS price FROM d WHERE event_type = (SELECT lo FROM t) GROUP BY 1, 2),
    l AS (SELECT event_id, client, day AS asked FROM d WHERE event_type <> (SELECT lo FROM t))"""
_ASOF = "SELECT event_id, l.client, asked, r.price, r.day AS matched_time FROM l ASOF LEFT JOIN r ON l.client = r.client AND l.asked {0} r.day"

ORACLE_SQL = {
    "period_changes_all": f"""WITH {_O}, q AS (SELECT who, (year(day) * 4 + quarter(day) - 1)::INT AS n, round(sum(amount), 2) AS a FROM o GROUP BY 1, 2),
        j AS (SELECT coalesce(x.who, y.who) AS who, coalesce(x.n + 1, y.n) AS n, coalesce(x.a, 0) AS before, coalesce(y.a, 0) AS after FROM q x FULL JOIN q y ON x.who = y.who AND x.n + 1 = y.n)
        SELECT who, make_date(n // 4, n % 4 * 3 + 1, 1) AS quarter, before, after, round(after - before, 2) AS change, CASE WHEN before = 0 AND after > 0 THEN 'new' WHEN before > 0 AND after = 0 THEN 'exit' WHEN after > before THEN 'added' WHEN after < before THEN 'cut' ELSE 'held' END AS kind
        FROM j WHERE n > (SELECT min(n) FROM q) AND n <= (SELECT max(n) FROM q)""",
    "stock_months": f"WITH {_O} SELECT CAST(date_trunc('month', day) AS DATE) AS month, priority, count(DISTINCT who) AS holders, round(sum(amount), 2) AS amount FROM o GROUP BY 1, 2",
    "month_prices": f"""WITH {_O}, m AS (SELECT who, CAST(date_trunc('month', day) AS DATE) AS month, max(CASE WHEN priority = '1-URGENT' THEN amount END) AS price FROM o GROUP BY 1, 2)
        SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY who ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM m""",
    "holders_latest_vs_prev": f"""WITH {_O}, q AS (SELECT who, CAST(date_trunc('quarter', day) AS DATE) AS quarter, round(sum(amount), 2) AS amount FROM o GROUP BY 1, 2),
        w AS (SELECT *, lag(amount) OVER (PARTITION BY who ORDER BY quarter) AS previous, lag(quarter) OVER (PARTITION BY who ORDER BY quarter) AS pq, row_number() OVER (PARTITION BY who ORDER BY quarter DESC) AS nth FROM q)
        SELECT who, quarter, amount, previous, round(CASE WHEN quarter - pq <= 120 THEN amount - previous END, 2) AS change FROM w WHERE nth = 1""",
    "latest_n_dates": f"WITH {_O}, r AS (SELECT *, dense_rank() OVER (PARTITION BY who ORDER BY day DESC)::INT AS nth FROM o) SELECT who, nth, count(*) AS n, max(day) AS day FROM r WHERE nth <= 2 GROUP BY 1, 2",
    "derive_quarters": f"""WITH {_O}, p AS (SELECT who, year(day)::INT AS year, quarter(day)::INT AS quarter, sum(amount) AS q FROM o GROUP BY 1, 2, 3), y AS (SELECT *, round(sum(q) OVER (PARTITION BY who, year ORDER BY quarter), 2) AS ytd FROM p)
        SELECT who, year, quarter, ytd, round(CASE WHEN quarter = 1 THEN ytd WHEN quarter - lag(quarter) OVER w = 1 THEN ytd - lag(ytd) OVER w END, 2) AS derived FROM y WINDOW w AS (PARTITION BY who, year ORDER BY quarter)""",
    "growth_yoy": f"""WITH {_O}, y AS (SELECT who, year(day)::INT AS year, round(sum(amount), 2) AS amount FROM o GROUP BY 1, 2)
        SELECT a.who, a.year, a.amount, b.amount AS year_ago, round(CASE WHEN b.amount > 0 THEN (a.amount / b.amount - 1) * 100 END, 4) AS growth_pct FROM y a LEFT JOIN y b ON a.who = b.who AND a.year = b.year + 1""",
    "weekly_bins": f"WITH {DEALS}, m AS (SELECT max(day) AS z FROM d) SELECT ((SELECT z FROM m) - day) // 7 AS bin, count(*) AS n, round(sum(quantity), 2) AS total FROM d WHERE (SELECT z FROM m) - day < 28 GROUP BY 1",
    "month_to_date": f"WITH {_O}, m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, round(sum(amount), 2) AS to_date FROM o WHERE day(day) <= 15 GROUP BY 1) SELECT *, lag(to_date) OVER (ORDER BY month) AS before FROM m",
    "daily_net_calendar_all": f"""WITH {DEALS}, c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day),
        s AS (SELECT day, round(sum(CASE WHEN side = 'SELL' THEN -quantity ELSE quantity END), 2) AS total FROM d GROUP BY 1) SELECT c.day, coalesce(total, 0.0::DOUBLE) AS total FROM c LEFT JOIN s ON s.day = c.day""",
    "sector_pivot_all": f"WITH {_O} SELECT who, {', '.join(f'count(*) FILTER (priority[1] = {chr(39)}{p}{chr(39)}) AS p{p}' for p in '12345')} FROM o GROUP BY 1",
    "unbroken_since": f"""WITH {DEALS}, n AS (SELECT DISTINCT client, (day - DATE '2024-01-01')::BIGINT AS number FROM d), i AS (SELECT *, number - row_number() OVER (PARTITION BY client ORDER BY number) AS g FROM n),
        r AS (SELECT client, min(number) AS since, max(number) AS upto, count(*) AS length, row_number() OVER (PARTITION BY client ORDER BY max(number) DESC) AS nth FROM i GROUP BY client, g) SELECT client, since, upto, length FROM r WHERE nth = 1""",
    "session_window_30m": f"""WITH {DEALS}, x AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) < 1800 THEN 0 ELSE 1 END AS opens FROM d WINDOW w AS (PARTITION BY client ORDER BY ts, event_id)),
        r AS (SELECT *, sum(opens) OVER (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT client, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM r GROUP BY client, run""",
    "window_tumbling": f"WITH {DEALS} SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(quantity), 2) AS total FROM d GROUP BY 1, 2",
    "session_window_stream": f"""WITH {DEALS}, x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM d WINDOW w AS (PARTITION BY client ORDER BY ts, event_id)),
        r AS (SELECT *, sum(opens) OVER (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT client, min(ts) AS start, count(*) AS n FROM r GROUP BY client, run""",
    "dedup_within_window": f"WITH {DEALS} SELECT client, count(DISTINCT date_trunc('hour', ts)) AS hours FROM d GROUP BY 1",
    "crossings": """WITH c AS (SELECT c_acctbal / 100 AS a, c_nationkey::DOUBLE AS b FROM customer), t AS (SELECT unnest([5, 10, 15, 20, 25, 50, 75])::INT AS threshold)
        SELECT threshold, a > b AS up, count(*) AS n FROM c JOIN t ON threshold > least(a, b) AND threshold <= greatest(a, b) GROUP BY 1, 2""",
    "fiscal_quarters": f"WITH {_O} SELECT 'FY' || year(day + INTERVAL 9 MONTH) || 'Q' || quarter(day + INTERVAL 9 MONTH) AS fq, count(*) AS n FROM o GROUP BY 1",
    "archive_merge_upsert": f"""WITH {DEALS}, e AS (SELECT client, event_type, day, round(quantity, 2) AS quantity, event_id FROM d),
        a AS (SELECT * FROM e WHERE day <= DATE '2024-01-15' QUALIFY row_number() OVER (PARTITION BY client, event_type ORDER BY event_id DESC) = 1),
        n AS (SELECT client, event_type, day, CASE WHEN event_id % 3 <> 0 THEN quantity END AS quantity, event_id FROM e WHERE day > DATE '2024-01-15' QUALIFY row_number() OVER (PARTITION BY client, event_type ORDER BY event_id DESC) = 1)
        SELECT coalesce(n.client, a.client) AS client, coalesce(n.event_type, a.event_type) AS event_type, coalesce(n.day, a.day) AS day, CASE WHEN n.client IS NULL THEN a.quantity ELSE coalesce(n.quantity, a.quantity) END AS quantity,
        coalesce(n.event_id, a.event_id) AS event_id, coalesce(a.day, DATE '2024-01-30') AS first_seen, CASE WHEN n.client IS NULL THEN DATE '2024-01-15' ELSE DATE '2024-01-30' END AS last_seen
        FROM a FULL JOIN n ON a.client = n.client AND a.event_type = n.event_type""",
    "archive_backfill": f"""WITH {DEALS}, e AS (SELECT client, event_type, round(quantity, 2) AS quantity, event_id FROM d),
        a AS (SELECT client, event_type, CASE WHEN event_id % 3 <> 0 THEN quantity END AS quantity, event_id FROM e WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY client, event_type ORDER BY event_id DESC) = 1),
        n AS (SELECT * FROM e WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY client, event_type ORDER BY event_id DESC) = 1)
        SELECT coalesce(a.client, n.client) AS client, coalesce(a.event_type, n.event_type) AS event_type, coalesce(a.quantity, n.quantity) AS quantity, coalesce(a.event_id, n.event_id) AS event_id FROM a FULL JOIN n ON a.client = n.client AND a.event_type = n.event_type""",
    "possibly_withdrawn": f"WITH {DEALS}, g AS (SELECT client, day, count(*) AS n FROM d GROUP BY 1, 2) SELECT * FROM g WHERE day + CAST(client % 5 AS INTEGER) < DATE '2024-01-30' AND day > DATE '2024-01-30' - 7",
    "pending_retries": f"WITH {_O}, t AS (SELECT who, count(*) AS tries, max(priority) = '1-URGENT' AS done FROM o GROUP BY 1) SELECT c_custkey AS who FROM customer WHERE c_custkey NOT IN (SELECT who FROM t WHERE done OR tries >= 8)",
    "due_next": f"WITH {_O}, t AS (SELECT who, max(day) AS fetched FROM o GROUP BY 1) SELECT c_custkey AS who, fetched FROM customer LEFT JOIN t ON who = c_custkey WHERE fetched IS NULL OR fetched < DATE '2001-08-01' - 30 ORDER BY fetched NULLS FIRST, c_custkey LIMIT 40",
    "asof_market_cap": f"""WITH {FILINGS}, {_O}, r AS (SELECT who, day, max(amount) AS amount FROM o GROUP BY 1, 2), j AS (SELECT f.second AS who, r.amount FROM f ASOF LEFT JOIN r ON f.second = r.who AND f.day_to >= r.day)
        SELECT who, count(*) AS n, count(amount) AS matched, round(sum(amount), 2) AS amount FROM j GROUP BY 1""",
    "asof_tolerance": f"WITH {_DR}, j AS ({_ASOF.format('>=')}) SELECT event_id, client, asked, CASE WHEN asked - matched_time <= 2 THEN price END AS price, CASE WHEN asked - matched_time <= 2 THEN matched_time END AS matched_time FROM j",
    "asof_strict": f"WITH {_DR} {_ASOF.format('>')}",
    "asof_forward": f"WITH {_DR} {_ASOF.format('<=')}",
    "asof_nearest": f"""WITH {_DR}, x AS ({_ASOF.format('>=')}), y AS ({_ASOF.format('<=')})
        SELECT x.event_id, x.client, x.asked, CASE WHEN x.matched_time IS NOT NULL AND (y.matched_time IS NULL OR x.asked - x.matched_time <= y.matched_time - x.asked) THEN x.price ELSE y.price END AS price,
        CASE WHEN x.matched_time IS NOT NULL AND (y.matched_time IS NULL OR x.asked - x.matched_time <= y.matched_time - x.asked) THEN x.matched_time ELSE y.matched_time END AS matched_time FROM x JOIN y ON x.event_id = y.event_id""",
    "matched_pairs": f"""WITH {DEALS}, p AS (SELECT a.event_id AS buy_id, b.event_id AS sell_id FROM d a JOIN d b ON a.security = b.security AND a.day = b.day AND a.client <> b.client AND abs(a.quantity - b.quantity) <= 0.2::DOUBLE * a.quantity WHERE a.side = 'BUY' AND b.side = 'SELL')
        SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY buy_id) = 1 AND count(*) OVER (PARTITION BY sell_id) = 1""",
    "pair_copies_ranked": f"""WITH {DEALS}, r AS (SELECT client, day, side, event_id, row_number() OVER (PARTITION BY client, day, side ORDER BY event_id) AS p FROM d)
        SELECT a.client, a.day, a.event_id AS left_id, b.event_id AS right_id FROM r a JOIN r b ON a.client = b.client AND a.day = b.day AND a.p = b.p WHERE a.side = 'BUY' AND b.side = 'SELL'""",
    "stage_link_status": f"""WITH {_O}, g AS (SELECT l.id AS later_id, count(DISTINCT e.id) AS n, min(e.id) AS e FROM o l LEFT JOIN o e ON e.who = l.who AND e.priority = '1-URGENT' AND e.day BETWEEN l.day - 180 AND l.day WHERE l.priority = '5-LOW' GROUP BY 1)
        SELECT later_id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN n = 1 THEN e END AS linked FROM g""",
    "deals_also_filed_all": f"""WITH {FILINGS}, {_O}
        SELECT who, EXISTS (SELECT 1 FROM f WHERE f.second = o.who AND o.day BETWEEN day_from AND day_to) AS in_span, count(*) AS n FROM o GROUP BY 1, 2""",
    "unmatched_prefix_resolve": """WITH s AS (SELECT lower(s_name) AS fname, s_suppkey AS code FROM supplier), n AS (SELECT substr(fname, 1, length(fname) - 1) AS name FROM s UNION SELECT fname FROM s)
        SELECT name, min(code) AS code FROM n JOIN s ON length(name) >= 4 AND length(fname) >= 4 AND (starts_with(name, fname) OR starts_with(fname, name)) GROUP BY 1 HAVING count(DISTINCT code) = 1""",
    "resolve_cascade": f"""WITH {_O}, a AS (SELECT s_suppkey AS k, min(s_name) AS v FROM supplier WHERE s_suppkey <= 50 GROUP BY 1 HAVING count(DISTINCT s_name) = 1), b AS (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY 1 HAVING count(DISTINCT s_name) = 1)
        SELECT CASE WHEN a.v IS NOT NULL THEN 'code' WHEN b.v IS NOT NULL THEN 'nation' ELSE 'unmatched' END AS resolved_by, count(*) AS n, count(coalesce(a.v, b.v)) AS named FROM o LEFT JOIN a ON a.k = who % 300 LEFT JOIN b ON b.k = who % 25 GROUP BY 1""",
    "unit_checks": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER (l_{c} IS NULL) AS nulls, count(*) FILTER (l_{c} < 0 OR l_{c} > 45) AS out_of_range, max(abs(l_{c})) AS largest, max(abs(l_{c})) <= 1 AS fractions FROM lineitem" for c in ("tax", "discount", "quantity")),
    "coverage_status": """WITH a AS (SELECT DISTINCT o_custkey AS w FROM orders), b AS (SELECT DISTINCT c_custkey + 3 AS w FROM customer)
        SELECT CASE WHEN a.w IS NULL THEN 'missing' WHEN b.w IS NULL THEN 'extra' ELSE 'both' END AS status, count(*) AS n FROM a FULL JOIN b ON a.w = b.w GROUP BY 1""",
    "add_up": f"""WITH {_O}, p AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS parts FROM lineitem GROUP BY 1)
        SELECT coalesce(p.id, o.id) AS id, round(parts, 2) AS parts, amount AS whole FROM p FULL JOIN o ON p.id = o.id WHERE coalesce(abs(parts - amount) > 100000, true)""",
    "data_health": "SELECT 'orders' AS source, count(*) AS rows, max(o_orderdate)::DATE AS latest FROM orders UNION ALL SELECT 'lineitem', count(*), max(l_shipdate)::DATE FROM lineitem UNION ALL SELECT 'events', count(*), max(ts)::DATE FROM events",
    "differing_fields": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_tax, l_returnflag) AS p FROM lineitem),
        j AS (SELECT (a.l_partkey <> b.l_partkey)::BIGINT AS l_partkey, (a.l_suppkey <> b.l_suppkey)::BIGINT AS l_suppkey, (a.l_tax <> b.l_tax)::BIGINT AS l_tax, (a.l_returnflag <> b.l_returnflag)::BIGINT AS l_returnflag FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.p > 1 AND b.p = 1)
        SELECT 'l_partkey' AS field, sum(l_partkey)::BIGINT AS n FROM j UNION ALL SELECT 'l_suppkey', sum(l_suppkey)::BIGINT FROM j UNION ALL SELECT 'l_tax', sum(l_tax)::BIGINT FROM j UNION ALL SELECT 'l_returnflag', sum(l_returnflag)::BIGINT FROM j""",
}
