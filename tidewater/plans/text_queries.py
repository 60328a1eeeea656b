"""Queries on names, documents, pages, conversations and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.bindings import deals
from tidewater.functions import names, values
from tidewater.operators import documents, periods
from tidewater.sources import files
from tidewater.sources.files import table

#: Ordered rules of a classifier, first match wins.
PART_RULES = [("promo", "promo"), ("standard", "standard|small"), ("metal", "steel|brass|copper|tin|nickel"), ("brushed", "brushed|polished")]


#: The reference's least word share, and a band of ids that stands for its hours.
SAME_WORDS, ID_BAND = 0.4, 200


def entity_key(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit("The "), "s_name", F.lit(" &amp; Co. Ltd")).alias("name"))
    return s.select("s_suppkey", names.entity_key(F.col("name")).alias("key"), names.display_name(F.upper("name")).alias("display"))


def entity_mode_spelling(spark, folder):
    c = table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"))
    return names.most_frequent_spelling(c, "name")


def rule_classifier(spark, folder):
    p = table(spark, folder, "part")
    return p.groupBy(names.first_pattern(F.lower("p_type"), PART_RULES, "other").alias("kind")).agg(F.count("*").alias("n"))


def rule_table_match(spark, folder):
    rules = spark.createDataFrame([(1, "^[a-c]", "early"), (2, "e", "has_e"), (3, ".", "rest")], "rule_no int, pattern string, label string")
    return names.rule_table_match(table(spark, folder, "nation"), "n_name", rules)


def flag_and_number(spark, folder):
    c = table(spark, folder, "customer").select(F.concat(F.lit("("), F.format_number(F.abs("c_acctbal"), 2), F.lit(")")).alias("neg"), F.format_number(F.abs("c_acctbal"), 2).alias("pos"), (F.col("c_custkey") % 2 == 0).cast("string").alias("flag"))
    return c.agg(F.round(F.sum(values.number(F.col("neg"))), 2).alias("neg"), F.round(F.sum(values.number(F.col("pos"))), 2).alias("pos"), F.count_if(values.flag(F.col("flag"))).alias("flags"))


def loose_dates(spark, folder):
    o = table(spark, folder, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n/a")
    day = values.loose_date(text)
    return o.groupBy(F.year(day).alias("year")).agg(F.count("*").alias("n"), F.min(day).alias("first"))


def json_props(spark, folder):
    e = table(spark, folder, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


def doc_clean_counts(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", documents.tidy_lines(F.col("text")).alias("lines"))
    return d.select("doc_id", F.size("lines").alias("lines"), F.coalesce(F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)).alias("chars"))


def doc_repeated_lines(spark, folder):
    out = documents.repeated_lines(table(spark, folder, "documents"), "doc_id", "text")
    return out.select(F.md5(F.col("line").cast("binary")).alias("line_md5"), "docs", "n")


def doc_furniture(spark, folder):
    d = table(spark, folder, "documents").select((F.col("doc_id") % 50).alias("file"), "doc_id", F.concat(F.lit("REPORT\n"), "text", F.lit("\npage 1")).alias("text"))
    out = documents.page_furniture(d, "file", "doc_id", "text")
    return out.select("file", F.md5(F.col("line").cast("binary")).alias("line_md5"), "pages")


def doc_numbers(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", documents.numbers_in(F.col("text")).alias("n"))
    return d.where(F.size("n") > 0).select("doc_id", F.size("n").alias("numbers"), F.element_at("n", 1).alias("first"), F.element_at("n", -1).alias("last"))


def doc_word_overlap_pairs(spark, folder):
    """The reference's same_filing, with the source for its key and an id band for its hours."""
    out = documents.overlap_pairs(table(spark, folder, "documents"), "doc_id", "source", "doc_id", "text", ID_BAND, SAME_WORDS)
    return out.select("a", "b", F.round("overlap", 6).alias("overlap"))


def page_title(spark, folder):
    return table(spark, folder, "pages").select("page_id", documents.html_title(F.col("html")).alias("title"))


def page_cells(spark, folder):
    p = table(spark, folder, "pages")
    return p.select("page_id", F.size(documents.html_cells(F.col("html"), "li")).alias("items"), F.size(documents.html_links(F.col("html"))).alias("links"), F.element_at(documents.html_links(F.col("html")), 1).alias("first_link"))


def page_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.length(documents.html_text(F.col("html"))).alias("chars"))


def xml_facts(spark, folder):
    r = table(spark, folder, "region").select("r_regionkey", F.concat(F.lit('<x:doc><x:Name c="a">'), "r_name", F.lit("</x:Name><x:Name>second</x:Name></x:doc>")).alias("xml"))
    return r.select("r_regionkey", F.array_join(documents.xml_facts(F.col("xml"), "Name"), "|").alias("names"))


def body_check(spark, folder):
    p = table(spark, folder, "pages").select(F.when(F.col("page_id") % 2 == 0, F.col("html")).when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.col("url")).cast("binary").alias("body"))
    return p.groupBy(files.body_check(F.col("body")).alias("status")).agg(F.count("*").alias("n"))


def conversation_filldown(spark, folder):
    c = table(spark, folder, "conversations").withColumn("asked", F.when(F.col("role") == "user", F.col("turn")))
    return periods.filled_forward(c, ["conv_id"], ["turn", "role"], "asked", "last_user_turn").select("conv_id", "turn", "role", "last_user_turn")


def buyer_groups(spark, folder):
    d = deals(spark, folder)
    group = names.first_rule([("fund", F.col("client") % 5 == 0), ("promoter", F.col("client") % 3 == 0), ("company", F.col("client") > 100)], "person")
    return d.groupBy(group.alias("buyer")).agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


QUERIES = {f.__name__: f for f in (entity_key, entity_mode_spelling, rule_classifier, rule_table_match, flag_and_number, loose_dates, json_props, doc_clean_counts, doc_repeated_lines, doc_furniture, doc_numbers, doc_word_overlap_pairs, page_title, page_cells, page_text, xml_facts, body_check, conversation_filldown, buyer_groups)}

_TIDY = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(trim(x), ' {3,}', ' | ', 'g'), ' {2}', ' ', 'g')), lambda x: x <> '' AND NOT regexp_full_match(x, '(page )?[0-9]{1,4}( of [0-9]{1,4})?'))"

ORACLE_SQL = {
    "entity_key": "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') || '-and' AS key, 'THE ' || upper(s_name[1]) || lower(s_name[2:]) || ' &amp; CO. LTD' AS display FROM supplier",
    "entity_mode_spelling": """WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name FROM customer), g AS (SELECT lower(name) AS key, name AS spelling, count(*) AS n FROM c GROUP BY 1, 2)
        SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, spelling) = 1""",
    "rule_classifier": """SELECT CASE WHEN coalesce(trim(p_type), '') = '' THEN 'missing' WHEN regexp_matches(lower(p_type), 'promo') THEN 'promo' WHEN regexp_matches(lower(p_type), 'standard|small') THEN 'standard'
        WHEN regexp_matches(lower(p_type), 'steel|brass|copper|tin|nickel') THEN 'metal' WHEN regexp_matches(lower(p_type), 'brushed|polished') THEN 'brushed' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1""",
    "rule_table_match": "SELECT DISTINCT n_name, CASE WHEN regexp_matches(lower(n_name), '^[a-c]') THEN 'early' WHEN regexp_matches(lower(n_name), 'e') THEN 'has_e' WHEN n_name <> '' THEN 'rest' END AS label FROM nation",
    "flag_and_number": "SELECT round(-sum(round(abs(c_acctbal), 2)), 2) AS neg, round(sum(round(abs(c_acctbal), 2)), 2) AS pos, count(*) FILTER (c_custkey % 2 = 0) AS flags FROM customer",
    "loose_dates": "WITH o AS (SELECT CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders) SELECT year(day)::INT AS year, count(*) AS n, min(day) AS first FROM o GROUP BY 1",
    "json_props": "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "doc_clean_counts": f"WITH d AS (SELECT doc_id, {_TIDY} AS l FROM documents) SELECT doc_id, len(l)::INT AS lines, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::INT AS chars FROM d",
    "doc_repeated_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT line, doc_id, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2) SELECT md5(line) AS line_md5, count(*) AS docs, sum(n)::BIGINT AS n FROM p GROUP BY line HAVING count(*) >= 2",
    "doc_furniture": r"""WITH p AS (SELECT doc_id % 50 AS file, doc_id AS page, list_filter(list_transform(string_split('REPORT' || chr(10) || text || chr(10) || 'page 1', chr(10)), lambda x: regexp_replace(lower(trim(x)), '[0-9]+', '#', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
        e AS (SELECT file, page, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2):])) AS line FROM p) SELECT file, md5(line) AS line_md5, count(DISTINCT page) AS pages FROM e GROUP BY file, line HAVING count(DISTINCT page) >= 3""",
    "doc_numbers": "WITH d AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[,.][0-9]+)*') AS n FROM documents) SELECT doc_id, len(n)::INT AS numbers, n[1] AS first, n[-1] AS last FROM d WHERE len(n) > 0",
    "doc_word_overlap_pairs": r"""WITH d AS (SELECT doc_id, source, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w))::DOUBLE / least(len(a.w), len(b.w)) AS overlap FROM d a JOIN d b ON a.source = b.source AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 200 WHERE len(a.w) > 0 AND len(b.w) > 0)
        SELECT a, b, round(overlap, 6) AS overlap FROM p WHERE overlap >= 0.4::DOUBLE""",
    "page_title": "SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title FROM pages",
    "page_cells": r"""SELECT page_id, len(regexp_extract_all(html, '<li(?:\s[^>]*)?>(.*?)</li>', 1, 'is'))::INT AS items, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS links, regexp_extract_all(html, 'href="([^"]*)"', 1)[1] AS first_link FROM pages""",
    "page_text": r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::INT AS chars FROM pages""",
    "xml_facts": "SELECT r_regionkey, r_name || '|second' AS names FROM region",
    "body_check": "SELECT CASE WHEN page_id % 2 = 0 THEN 'html_instead' WHEN page_id % 5 = 0 THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM pages GROUP BY 1",
    "conversation_filldown": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_turn FROM conversations",
    "buyer_groups": "SELECT CASE WHEN user_id % 5 = 0 THEN 'fund' WHEN user_id % 3 = 0 THEN 'promoter' WHEN user_id > 100 THEN 'company' ELSE 'person' END AS buyer, count(*) AS n, round(sum(value), 2) AS quantity FROM events GROUP BY 1",
}
