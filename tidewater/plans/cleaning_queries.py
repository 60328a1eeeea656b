"""Queries on cleaning: sides, roles, names, membership, schemes and counts of flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.bindings import BARS, DEALS, FILINGS, bars, deals, filings
from tidewater.operators import cleaning
from tidewater.sources.files import table


def sides_of_trades(spark, folder):
    li = table(spark, folder, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "Disposal").when(F.col("l_returnflag") == "A", "Acquisition of shares")
    mode = F.when(F.col("l_linestatus") == "F", "Market Purchase").when(F.col("l_linenumber") > 5, "Market Sale").when(F.col("l_linenumber") > 3, "Purchase or Sale").otherwise("Pledge revoked")
    return li.groupBy(cleaning.side_of(kind, mode).alias("side")).agg(F.count("*").alias("n"))


def filled_roles(spark, folder):
    d = deals(spark, folder).select("client", "security", F.when(F.col("quantity") < 30, "missing").otherwise(F.col("event_type")).alias("role"))
    return cleaning.filled_roles(d, ["client"], "role").groupBy("role", "role_source").agg(F.count("*").alias("n"))


def merged_cut_names(spark, folder):
    """Part names by brand as keys; every fourth is cut three letters short."""
    p = table(spark, folder, "part").select("p_brand", F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), F.lit("limited"), F.col("p_partkey").cast("string")).alias("key"), "p_partkey")
    cut = p.where("p_partkey % 4 = 0").withColumn("key", F.expr("substring(key, 1, length(key) - 3)")).unionByName(p)
    return cleaning.merged_cut_names(cut.withColumn("raw", F.col("key")), "p_brand", "key", "raw").where("merged <> key").select("p_brand", "key", "merged")


def group_members(spark, folder):
    f = filings(spark, folder)
    lists = f.where("line = 1").select("security", F.col("person").alias("member"), F.col("second").alias("member_alt"), F.trunc("day_from", "quarter").alias("quarter"))
    out = cleaning.group_members(f.where("line > 1"), cleaning.latest_lists(lists, "security", "quarter"), "security", "person", "second")
    return out.groupBy("security", "group_id", "group_key").agg(F.count("*").alias("n"))


def _schemes(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("second"), F.col("c_nationkey").alias("house"), F.col("c_mktsegment").alias("scheme"))
    f = filings(spark, folder).join(c, "second")
    return f.select("house", "scheme", "security", "quantity", F.year("day_from").alias("year")).where("year in (1996, 1997)")


def _scheme_changes(spark, folder):
    s = _schemes(spark, folder)
    factors = table(spark, folder, "part").where("p_size % 7 = 0").select(F.col("p_partkey").alias("security"), F.lit(2.0).alias("factor"))
    return cleaning.scheme_changes(s.where("year = 1997"), s.where("year = 1996"), factors, ["house", "scheme"], "security", "quantity")


def scheme_changes(spark, folder):
    return _scheme_changes(spark, folder)


def scheme_month(spark, folder):
    prices = bars(spark, folder).where("day >= '1998-01-01'").groupBy("security").agg(F.floor(F.round(F.max("close"), 6)).cast("double").alias("price"))
    return cleaning.scheme_totals(_scheme_changes(spark, folder), prices, ["house", "scheme"], "security")


def flags_report(spark, folder):
    f = filings(spark, folder)
    flags = F.array_compact(F.array(F.when(F.col("day_to") < F.col("day_from"), "dates_out_of_order"), F.when(F.col("value") > 90_000, "large"), F.when(F.col("tax") > F.col("discount"), "tax_above_discount")))
    return cleaning.flag_counts(f.select(flags.alias("flags")), "flags")


def unrecognised_values(spark, folder):
    o = table(spark, folder, "orders")
    return cleaning.unrecognised(o, {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})


def unit_words(spark, folder):
    words = F.element_at(F.array(*[F.lit(w) for w in ("lakh", "Crores.", "million", "rupees", "Bn")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    near = F.when(F.col("l_returnflag") == "R", " ").otherwise(" or more of 7 in ")
    quote = F.concat(F.lit("worth "), F.col("l_quantity").cast("int").cast("string"), near, F.lower(words))
    li = table(spark, folder, "lineitem").select(words.alias("unit"), F.col("l_quantity").alias("v"), quote.alias("quote"), F.when(F.col("l_linestatus") == "F", "exact").otherwise("table").alias("kind"))
    return li.groupBy("unit", "kind", cleaning.unit_multiplier(F.col("unit")).alias("multiplier"), cleaning.unit_backed(F.col("v"), F.col("unit"), F.col("quote"), F.col("kind")).alias("backed")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (sides_of_trades, filled_roles, merged_cut_names, group_members, scheme_changes, scheme_month, flags_report, unrecognised_values, unit_words)}

_SCHEMES = f"""{FILINGS}, q AS (SELECT c_nationkey AS house, c_mktsegment AS scheme, security, quantity, year(day_from) AS year FROM f JOIN customer ON c_custkey = second WHERE year(day_from) IN (1996, 1997)),
    hb AS (SELECT house FROM q WHERE year = 1996 INTERSECT SELECT house FROM q WHERE year = 1997),
    a AS (SELECT house, scheme, security, sum(quantity) AS s FROM q WHERE year = 1996 AND house IN (SELECT house FROM hb) GROUP BY 1, 2, 3), e AS (SELECT house, scheme, security, sum(quantity) AS s FROM q WHERE year = 1997 AND house IN (SELECT house FROM hb) GROUP BY 1, 2, 3),
    m AS (SELECT coalesce(a.house, e.house) AS house, coalesce(a.scheme, e.scheme) AS scheme, coalesce(a.security, e.security) AS security, coalesce(a.s, 0) AS s0, coalesce(e.s, 0) AS "end" FROM a FULL JOIN e ON a.house = e.house AND a.scheme = e.scheme AND a.security = e.security),
    n AS (SELECT m.*, s0 * CASE WHEN p_size % 7 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS start FROM m LEFT JOIN part ON p_partkey = security),
    ch AS (SELECT house, scheme, security, start, "end", "end" - start AS change, CASE WHEN start = 0 AND "end" > 0 THEN 'new' WHEN start > 0 AND "end" = 0 THEN 'exit' WHEN "end" > start THEN 'added' WHEN "end" < start THEN 'cut' ELSE 'held' END AS status,
        CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.house = n.house AND e.scheme = n.scheme) THEN 'start_only' WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.house = n.house AND a.scheme = n.scheme) THEN 'end_only' ELSE 'both' END AS scheme_seen FROM n)"""

ORACLE_SQL = {
    "sides_of_trades": """SELECT CASE WHEN l_returnflag = 'R' THEN 'SELL' WHEN l_returnflag = 'A' THEN 'BUY' WHEN l_linestatus = 'F' THEN 'BUY' WHEN l_linenumber > 5 THEN 'SELL' WHEN l_linenumber > 3 THEN 'BUY' END AS side, count(*) AS n FROM lineitem GROUP BY 1""",
    "filled_roles": f"""WITH {DEALS}, r AS (SELECT client, CASE WHEN quantity < 30 THEN 'missing' ELSE event_type END AS role FROM d),
        k AS (SELECT client, role, row_number() OVER (PARTITION BY client ORDER BY count(*) DESC, role) AS p FROM r WHERE role <> 'missing' GROUP BY 1, 2)
        SELECT CASE WHEN r.role = 'missing' THEN coalesce(k.role, 'missing') ELSE r.role END AS role, CASE WHEN r.role <> 'missing' THEN 'filing' WHEN k.role IS NOT NULL THEN 'other_filing' ELSE 'missing' END AS role_source, count(*) AS n
        FROM r LEFT JOIN k ON k.client = r.client AND p = 1 GROUP BY 1, 2""",
    "merged_cut_names": """WITH p AS (SELECT p_brand, concat_ws('-', replace(p_name, ' ', '-'), 'limited', p_partkey) AS key, p_partkey FROM part),
        n AS (SELECT DISTINCT p_brand, key FROM p UNION SELECT p_brand, key[1:len(key) - 3] FROM p WHERE p_partkey % 4 = 0),
        h AS (SELECT s.p_brand, s.key, min(l.key) AS long FROM n s JOIN n l ON l.p_brand = s.p_brand AND len(l.key) > len(s.key) AND starts_with(l.key, s.key) WHERE len(s.key) >= 15 GROUP BY 1, 2 HAVING count(*) = 1),
        g AS (SELECT *, long[len(key) + 1:] AS rest, string_split(long[len(key) + 2:], '-') AS added FROM h),
        c AS (SELECT *, ['private', 'limited', 'llp', 'company', 'corporation', 'holding', 'holdings', 'investment', 'investments', 'ventures', 'enterprises', 'capital', 'fund', 'industries', 'associates', 'partners', 'finance', 'securities', 'international', 'inc'] AS firm FROM g),
        o AS (SELECT p_brand, key, long FROM c WHERE NOT starts_with(rest, '-') OR (len(key) BETWEEN 26 AND 32 AND NOT list_has_any(added, ['huf', 'trust', 'family', 'foundation', 'estate', 'minor']) AND (NOT list_has_any(added, firm) OR list_has_any(string_split(key, '-'), firm)))),
        r AS (SELECT p_brand, key FROM p UNION ALL SELECT p_brand, key[1:len(key) - 3] FROM p WHERE p_partkey % 4 = 0)
        SELECT r.p_brand, r.key, long AS merged FROM r JOIN o ON o.p_brand = r.p_brand AND o.key = r.key""",
    "group_members": f"""WITH {FILINGS}, l AS (SELECT security, person, second, date_trunc('quarter', day_from) AS q FROM f WHERE line = 1), t AS (SELECT * FROM l QUALIFY q = max(q) OVER (PARTITION BY security)),
        x AS (SELECT security, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.security = f.security AND t.person = f.person) THEN 'name' WHEN EXISTS (SELECT 1 FROM t WHERE t.security = f.security AND (t.person = f.second OR t.second = f.second)) THEN 'alternative' END AS group_key FROM f WHERE line > 1)
        SELECT security, CASE WHEN group_key IS NOT NULL THEN 'group:' || security END AS group_id, group_key, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "scheme_changes": f"WITH {_SCHEMES} SELECT * FROM ch",
    "scheme_month": f"""WITH {_SCHEMES}, {BARS}, pr AS (SELECT security, floor(round(max(close), 6)) AS price FROM b WHERE day >= DATE '1998-01-01' GROUP BY 1)
        SELECT house, scheme, round(sum(change * price), 2) AS net, round(sum(greatest(change * price, 0.0::DOUBLE)), 2) AS bought, round(sum(least(change * price, 0.0::DOUBLE)), 2) AS sold, count(*) FILTER (change > 0) AS adding, count(*) FILTER (change < 0) AS cutting,
        count(*) FILTER (status = 'new') AS "new", count(*) FILTER (status = 'exit') AS exits, count(*) FILTER ("end" > 0) AS holdings, count(*) FILTER (price IS NULL AND change <> 0) AS unvalued FROM ch LEFT JOIN pr ON pr.security = ch.security GROUP BY 1, 2""",
    "flags_report": f"""WITH {FILINGS}, x AS (SELECT unnest(list_filter([CASE WHEN day_to < day_from THEN 'dates_out_of_order' END, CASE WHEN value > 90000 THEN 'large' END, CASE WHEN tax > discount THEN 'tax_above_discount' END], lambda v: v IS NOT NULL)) AS flag FROM f) SELECT flag, count(*) AS n FROM x GROUP BY 1""",
    "unrecognised_values": """SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 2""",
    "unit_words": """WITH x AS (SELECT (['lakh', 'Crores.', 'million', 'rupees', 'Bn'])[l_linenumber % 5 + 1] AS unit, l_returnflag = 'R' AS near, l_linestatus = 'F' AS exact FROM lineitem)
        SELECT unit, CASE WHEN exact THEN 'exact' ELSE 'table' END AS kind, CASE unit WHEN 'lakh' THEN 1e5::DOUBLE WHEN 'Crores.' THEN 1e7::DOUBLE WHEN 'million' THEN 1e6::DOUBLE WHEN 'Bn' THEN 1e9::DOUBLE ELSE 1.0::DOUBLE END AS multiplier, CASE WHEN unit <> 'rupees' THEN NOT exact OR near END AS backed, count(*) AS n FROM x GROUP BY 1, 2, 3, 4""",
}
