"""Queries over the whole of their tables, against brute force on small tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater import queries
from tidewater.operators import documents, linkage

START = dt.datetime(2020, 1, 1)


def day(n):
    return START + dt.timedelta(n)


@pytest.fixture
def trades(spark, tmp_path):
    """140 sessions of security 1 (and 26, the same by % 25) in small trades of both sides."""
    items = [(n, 1, 1 + 25 * k, 7, "R" if n % 2 else "N", 1.0 + n % 3, (1.0 + n % 3) * (100 + 50 * k + (n * 37) % 11), 0.0, 0.0, day(n), "F") for n in range(140) for k in (0, 1) if k == 0 or n % 4]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_tax double, l_discount double, l_shipdate timestamp, l_linestatus string"
    spark.createDataFrame(items, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(n, 5, day(n - 1)) for n in range(140)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path), {(r[2], r[0]): r[6] / r[5] for r in items}, items


def test_every_filing_has_its_own_securitys_return(spark, trades):
    folder, close, items = trades
    got = {(r.order_id, r.security): r for r in queries.QUERIES["forward_returns"](spark, folder).collect()}
    assert got.keys() == {(r[0], r[2]) for r in items}
    for (n, security), r in got.items():
        entry = close.get((security, n + 1))
        assert r.entry == (None if entry is None else pytest.approx(entry, abs=1e-3))
        for h in (5, 21, 63, 126):
            out = close.get((security, n + 1 + h))
            assert r[f"r_{h}"] == (None if entry is None or out is None else pytest.approx((out / entry - 1) * 100 - 0.25, abs=1e-3))


def test_summary_has_both_sides_and_all_horizons(spark, trades):
    folder, _, _ = trades
    want = {(s, h) for s in ("BUY:2", "SELL:2") for h in (5, 21, 63, 126)}
    assert {(r.signal, r.horizon) for r in queries.QUERIES["track_summary"](spark, folder).collect()} == want
    assert {(r.signal, r.horizon) for r in queries.QUERIES["evidence_verdict"](spark, folder).collect()} == want


def test_small_trades_are_spaced(spark, trades):
    folder, _, _ = trades
    assert sorted(r.number for r in queries.QUERIES["spacing_21_sessions"](spark, folder).collect()) == list(range(1, 141, 21))
    assert sorted((r.entry_no, r.exit_no) for r in queries.QUERIES["basket_positions"](spark, folder).collect()) == [(2, 65), (66, 129), (130, 193)]


def test_high_of_the_default_window(spark, trades):
    folder, close, _ = trades
    got = {r.day: r.high_close for r in queries.QUERIES["high_52w_distance"](spark, folder).where("security = 1").collect()}
    for n in range(140):
        assert got[day(n).date()] == (None if n < 119 else pytest.approx(max(close[1, i] for i in range(n + 1)), abs=1e-3))


def test_deals_in_long_spans_of_their_own_customer(spark, tmp_path):
    """Customer 1 has a long span that holds a bare order; customer 201 (the same by % 200) has none."""
    orders = [(1, 1, day(0)), (2, 1, day(100)), (3, 1, day(400)), (4, 201, day(100))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").selectExpr("*", "1.0D as o_totalprice", "'1-URGENT' as o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    items = spark.createDataFrame([(1, day(300)), (3, day(390))], "l_orderkey long, l_shipdate timestamp")
    items.selectExpr("*", "1 as l_linenumber", "1L as l_partkey", "1L as l_suppkey", "'N' as l_returnflag", "1.0D as l_quantity", "1.0D as l_extendedprice", "0.0D as l_tax", "0.0D as l_discount", "'F' as l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.QUERIES["deals_also_filed"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, False, 1), (1, True, 2), (201, False, 1)]


def test_exists_in_span_equals_brute_force(spark):
    """Nested, touching, long and reversed spans, and nulls."""
    spans = [("a", 0, 50), ("a", 5, 9), ("a", 50, 60), ("a", 70, 65), ("b", 3, 3), ("b", None, 9), (None, 0, 99), ("c", 1, 400), ("c", 2, 3)]
    days = [(k, d) for k in ("a", "b", "c", "d", None) for d in (0, 3, 7, 51, 60, 61, 67, 300, 401, None)]
    out = linkage.exists_in_span(spark.createDataFrame(days, "k string, d int"), spark.createDataFrame(spans, "k string, lo int, hi int"), ["k"], "d", "lo", "hi")
    want = {(k, d): any(k is not None and k == s and d is not None and lo is not None and lo <= d <= hi for s, lo, hi in spans) for k, d in days}
    assert {(r.k, r.d): r.in_span for r in out.collect()} == want


def test_word_overlap_of_every_pair_of_a_band(spark, tmp_path):
    """Copies whose openings differ, a third copy, a block's edge, another source, beyond the band, and no text."""
    body = " ".join(f"w{i}" for i in range(40))
    docs = [(190, "s", f"A{body}"), (195, "s", f"B{body}"), (205, "s", f"A{body}"), (206, "t", f"A{body}"), (391, "s", f"C{body}"), (200, "s", "quite other words"), (201, "s", None), (202, "s", " ")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.a, r.b): r.overlap for r in queries.QUERIES["doc_word_overlap_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(190, 195): 0.975, (190, 205): 1.0, (195, 205): 0.975, (195, 391): 0.975, (205, 391): 0.975}


def test_word_overlap_counts_pairs_where_their_block_is(spark, tmp_path):
    """Texts are read and cut once, and dealt out once; repeated, negative and null ids, and a short text in a long one, as all pairs have it."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(rng.randrange(-300, 700), rng.choice("st"), " ".join(rng.choices(words, k=rng.choice([1, 5, 30, 90])))) for _ in range(160)]
    docs += [docs[0], (docs[0][0], docs[0][1], "w1 w2"), (None, "s", "w1"), (5, None, "w1"), (6, "s", "W1\t\n w1")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = [(i, k, set(t.lower().split())) for i, k, t in docs if i is not None and k is not None]
    pairs = [(i, j, round(len(x & y) / min(len(x), len(y)), 6)) for i, k, x in sets for j, m, y in sets if k == m and i < j <= i + 200 and len(x & y) / min(len(x), len(y)) >= 0.4]
    df = queries.QUERIES["doc_word_overlap_pairs"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(pairs) and len(pairs) > 100
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_changes_of_all_quarters_and_all_priorities(spark, tmp_path):
    """A year's turn, a quarter without orders, and years other than 1997."""
    rows = [(1, 1, dt.datetime(1995, 11, 1), 10.0, "4-NOT SPECIFIED"), (2, 1, dt.datetime(1996, 2, 1), 15.0, "5-LOW"), (3, 2, dt.datetime(1996, 8, 1), 7.0, "1-URGENT"), (4, 2, dt.datetime(1996, 11, 1), 7.0, "5-LOW")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries.QUERIES["period_changes"](spark, str(tmp_path)).select("who", "quarter", "kind").collect()
    q = lambda m: dt.date(1996, m, 1)
    assert sorted(map(tuple, got)) == [(1, q(1), "added"), (1, q(4), "exit"), (2, q(7), "new"), (2, q(10), "held")]
    assert sorted(map(tuple, queries.QUERIES["sector_pivot"](spark, str(tmp_path)).collect())) == [(1, 0, 0, 0, 1, 1), (2, 1, 0, 0, 0, 1)]


def test_calendar_has_sundays_and_the_datas_ends(spark, tmp_path):
    """2023-12-31 is a Sunday before the old calendar, 2024-03-02 a day after it."""
    events = [(1, dt.datetime(2023, 12, 31, 5), "a", 2.0), (2, dt.datetime(2024, 1, 3, 5), "b", 3.0), (3, dt.datetime(2024, 3, 2, 5), "c", 4.0)]
    spark.createDataFrame(events, "event_id long, ts timestamp, event_type string, value double").selectExpr("*", "1L as user_id", "'{}' as props").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.day: r.total for r in queries.QUERIES["daily_net_calendar"](spark, str(tmp_path)).collect()}
    assert len(got) == 63 and {d: t for d, t in got.items() if t} == {dt.date(2023, 12, 31): -2.0, dt.date(2024, 1, 3): 3.0, dt.date(2024, 3, 2): -4.0}


def test_furniture_gathers_no_text(spark, folder):
    """The plan holds no list of texts, and a form feed in a text makes no further page."""
    plan = queries.QUERIES["doc_furniture"](spark, folder)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    pages = spark.createDataFrame([(1, i, f"Head {i}\nbody\fbody {i}\nFoot") for i in range(3)] + [(1, 3, None), (1, 4, "")], "d int, p int, t string")
    assert {(r.line, r.pages) for r in documents.page_furniture(pages, "d", "p", "t").collect()} == {("head #", 3), ("body\fbody #", 3), ("foot", 3)}


def test_unique_prefix_makes_no_pairs_of_a_common_opening(spark):
    """Names in both directions; 300 names that begin alike are joined by equality alone, and no pair is made to be tested after."""
    master = [(f"supplier{i:04d}x", i) for i in range(300)] + [("short", 900), ("shorter", 901), ("abc", 902)]
    asked = [f"supplier{i:04d}" for i in range(300)] + ["supplier0007xyz", "supplier", "short", "shorte", "shortest", "abc", "abcd", None]
    m = spark.createDataFrame(master, "full string, code int")
    out = linkage.unique_prefix(spark.createDataFrame([(x,) for x in asked], "name string"), m, "name", "full", "code")
    hits = {x: {c for f, c in master if x and min(len(x), len(f)) >= 4 and (x.startswith(f) or f.startswith(x))} for x in asked}
    assert {r.name: r.code for r in out.collect()} == {x: min(c) for x, c in hits.items() if len(c) == 1}
    assert "startswith" not in out._jdf.queryExecution().toString().lower()
