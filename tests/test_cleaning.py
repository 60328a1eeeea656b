"""Sides, roles, cut names, membership and schemes on small tables with nulls and ties."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import cleaning, trades


def test_type_decides_and_mode_falls_back(spark):
    rows = [("Disposal", "Market Purchase"), (None, "Market Sale"), ("-", "Purchase or Sale"), ("Buyer's Sale", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, m string")
    assert [r.s for r in df.select(cleaning.side_of(F.col("t"), F.col("m")).alias("s")).collect()] == ["SELL", "SELL", "BUY", "BUY", None]


def test_roles_fill_from_the_most_frequent(spark):
    rows = [(1, "kmp"), (1, "kmp"), (1, "director"), (1, "missing"), (2, "b"), (2, "a"), (2, None), (3, "missing"), (None, "missing"), (None, "a")]
    got = cleaning.filled_roles(spark.createDataFrame(rows, "k int, role string"), ["k"], "role").collect()
    assert sorted((r.k or 0, r.role, r.role_source) for r in got if r.role_source != "filing") == [(0, "missing", "missing"), (1, "kmp", "other_filing"), (2, "a", "other_filing"), (3, "missing", "missing")]


def test_names_merge_only_when_cut(spark):
    long = "north-harbour-investments-leith-private-limited"
    rows = [("s", long, long), ("s", long[:31], "North Harbour Investments (Lei"), ("s", "peter-john-maywood", "Peter John Maywood"), ("s", "peter-john-maywood-huf", "Peter John Maywood HUF"), ("t", long[:31], "North Harbour Investments (Lei"), ("s", None, None), ("s", "short", "Short"), ("s", "shorter", "Shorter")]
    got = cleaning.merged_cut_names(spark.createDataFrame(rows, "sec string, p string, raw string"), "sec", "p", "raw").collect()
    assert {(r.sec, r.p) for r in got if r.merged != r.p} == {("s", long[:31])} and len(got) == len(rows)


def test_members_link_by_name_then_alternative(spark):
    lists = spark.createDataFrame([(1, "a", "x", 1), (1, "b", None, 2), (1, "c", "y", 2), (None, "d", None, 9)], "co int, member string, member_alt string, q int")
    trades = spark.createDataFrame([(1, "b", "b"), (1, "z", "y"), (1, "a", "x"), (2, "b", "b"), (1, None, None)], "co int, p string, alt string")
    got = cleaning.group_members(trades, cleaning.latest_lists(lists, "co", "q"), "co", "p", "alt").collect()
    assert {(r.co, r.p, r.group_key, r.group_id) for r in got} == {(1, "b", "name", "group:1"), (1, "z", "alternative", "group:1"), (1, "a", None, None), (2, "b", None, None), (1, None, None, None)}


def test_schemes_on_todays_shares(spark):
    schema = "h string, s string, i string, q double"
    before = spark.createDataFrame([("h", "a", "X", 5.0), ("h", "a", "Y", 1.0), ("h", "old", "X", 1.0), ("gone", "a", "X", 1.0)], schema)
    now = spark.createDataFrame([("h", "a", "X", 10.0), ("h", "new", "X", 1.0), ("came", "a", "X", 1.0)], schema)
    factors = spark.createDataFrame([("X", 2.0)], "i string, factor double")
    ch = cleaning.scheme_changes(now, before, factors, ["h", "s"], "i", "q")
    assert {(r.s, r.i, r.change, r.status, r.scheme_seen) for r in ch.collect()} == {("a", "X", 0.0, "held", "both"), ("a", "Y", -1.0, "exit", "both"), ("old", "X", -2.0, "exit", "start_only"), ("new", "X", 1.0, "new", "end_only")}
    total = {r.s: r for r in cleaning.scheme_totals(ch, spark.createDataFrame([("X", 3.0)], "i string, price double"), ["h", "s"], "i").collect()}
    assert (total["a"].net, total["a"].unvalued, total["old"].sold, total["new"].bought) == (0.0, 1, -6.0, 3.0)


def test_units_and_flags(spark):
    df = spark.createDataFrame([(5.0, "Crores", "a sum of 5 crore"), (5.0, "crore", "five of them, in crore"), (95e6, "crore", "9,50,00,000 crore"), (5.0, "rupees", "5"), (None, None, None)], "v double, u string, q string")
    assert [r.b for r in df.select(cleaning.unit_backed(F.col("v"), F.col("u"), F.col("q")).alias("b")).collect()] == [True, False, False, None, None]
    odd = cleaning.unrecognised(spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,)], "f string"), {"f": ["a"]}).collect()
    assert [tuple(r) for r in odd] == [("f", "b", 2)]
    assert cleaning.flag_counts(spark.createDataFrame([(["x", "y"],), (["x"],), ([],), (None,)], "fl array<string>"), "fl").where("flag = 'x'").first().n == 2


def test_sides_by_stems(spark):
    rows = [("Acquired", None, "BUY"), ("Disposed", None, "SELL"), ("Purchase or Sale", None, "BUY"), ("Allotment", None, None), ("Pledge", "Market Sale", "SELL"), ("PLEDGE REVOKE", None, None), ("Sale of pledged shares", None, "SELL"), (None, None, None), ("-", "Market Purchase", "BUY"), ("Disposal", "Market Purchase", "SELL")]
    df = spark.createDataFrame(rows, "kind string, mode string, want string")
    assert [r.got for r in df.select(cleaning.side_of(F.col("kind"), F.col("mode")).alias("got")).collect()] == [r[2] for r in rows]


def test_units_are_backed_by_their_own_word(spark):
    words = "Rs. 1,99,99,99,852.45 (Rupees One Hundred Ninety-Nine Crore Ninety-Nine Lakh only)"
    rows = [
        (1999999852.45, "crore", words, "exact", False), (950000000.0, "crore", "Size: INR 95,00,00,000", "table", False), (1999999852.45, "rupees", words, "exact", None),
        (15.5, None, "a sum of USD 15.5 billion by 2030", "exact", False), (15.5, "rupees", "15.5 bn", "exact", False), (162.0, None, "at Rs. 162 per share", "exact", None), (28200.0, "lakh", "up to 28,200.00 Lakhs (Rupees", "exact", True),
        (102.0, "Cr", "worth Rs. 102 Cr. of which", "exact", True), (200.0, "crore", "Total 200.00", "table", True), (200.0, "crore", "Total 200.00 and 5 crore", "exact", False), (88.0, "crore", "Total Income (Rs Cr)  88  137", "exact", True),
        (238.0, "mn", "ZAR 238 mn", "exact", True), (None, "crore", "5 crore", "exact", False), (5.0, "crore", None, "exact", False), (5.0, "crore", "5 lakh", "exact", False), (12.0, "crore", "12 crorepati", "exact", False),
    ]
    df = spark.createDataFrame(rows, "v double, u string, q string, k string, want boolean")
    assert [r.b for r in df.select(cleaning.unit_backed(F.col("v"), F.col("u"), F.col("q"), F.col("k")).alias("b")).collect()] == [r[4] for r in rows]


def test_breadth_sums_rupees_of_decision_makers(spark):
    day = dt.date(2024, 6, 30)
    back = lambda n: day - dt.timedelta(days=n)
    rows = [("x", "BUY", 100.0, back(0), True, False), ("x", "BUY", 50.0, back(29), True, False), ("y", "BUY", 10.0, back(3), True, True), ("y", "SELL", 50.0, back(3), True, None), ("z", "SELL", 9.0, back(1), False, False), ("z", "BUY", 7.0, back(30), True, None), (None, "BUY", 5.0, back(1), True, False), ("z", "BUY", 5.0, back(-1), True, False)]
    df = spark.createDataFrame(rows, "s string, side string, v double, d date, decides boolean, token boolean")
    got = trades.breadth(df, "d", F.lit(day), 30, "side", "v", "s", F.col("decides"), F.col("token")).first()
    assert (got.buy_value, got.buy_securities, got.sell_value, got.sell_securities, got.buy_share) == (150.0, 1, 50.0, 1, 75.0)
    assert got.buy_value_before is None and got.buy_share_before is None
    old = df.unionByName(spark.createDataFrame([("w", "SELL", 1.0, back(59), True, False)], df.schema))
    got = trades.breadth(old, "d", F.lit(day), 30, "side", "v", "s", F.col("decides"), F.col("token")).first()
    assert (got.buy_value_before, got.buy_securities_before, got.sell_value_before, got.buy_share_before) == (7.0, 1, 1.0, 87.5)
