"""Event builders, the day's lists, holdings and price factors on small tables with nulls, ties and empty input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import archive, dedup, holdings, linkage, signals, trades

D = dt.date
EVENT = "security int, list string, kind string, pct double, value double, last date"


def test_stake_events_by_change_and_by_line(spark):
    rows = [(1, "a", 2.0, None, None, D(2024, 1, 1)), (2, "a", 1.0, None, 5.5, D(2024, 1, 1)), (3, "a", 1.0, None, 9.0, D(2024, 1, 1)), (4, "a", None, 0.5, 4.8, D(2024, 1, 1)), (5, "a", None, None, None, None), (1, "a", 2.0, None, None, D(2024, 1, 3))]
    got = signals.stake_events(spark.createDataFrame(rows, "security int, holder string, pct_bought double, pct_sold double, pct_after double, day date")).collect()
    assert {(r.security, r.list, r.pct, r.last) for r in got} == {(1, "look", 2.0, D(2024, 1, 3)), (2, "look", 1.0, D(2024, 1, 1)), (4, "warn", 0.5, D(2024, 1, 1))}


def test_pledges_net_within_what_is_held(spark):
    rows = [(1, "a", 100.0, "create", 40.0, D(2024, 1, 1)), (1, "a", 100.0, "revoke", None, D(2024, 1, 2)), (2, "a", 100.0, "create", 40.0, D(2024, 1, 1)), (3, "b", 7.0, "revoke", None, D(2024, 1, 1))]
    shares = spark.createDataFrame([(1, 1000.0), (2, 1000.0), (3, 0.0)], "security int, total double")
    got = signals.pledge_events(spark.createDataFrame(rows, "security int, person string, quantity double, kind string, held double, day date"), shares).collect()
    assert {(r.security, r.kind, r.pct) for r in got} == {(2, "pledge_created", 4.0), (3, "pledge_released", None)}


def test_today_leads_by_group_and_lifts_the_largest(spark):
    rows = [(1, "look", "b", 9.0, None, None), (1, "look", "a", 1.0, 5.0, D(2024, 1, 1)), (2, "look", "a", 2.0, 900.0, D(2024, 1, 1)), (3, "look", "a", 8.0, 800.0, D(2024, 1, 1)), (4, "look", "z", 1.0, None, None), (None, "look", "a", 1.0, None, None)]
    got = signals.today(spark.createDataFrame(rows, EVENT), {"look": [("first", ["a"]), ("second", ["b"])]}, big=700, most_lifted=1)
    assert [(r.group, r.place, r.security, r.kind, r.kinds) for r in got.orderBy("group_order", "place").collect()] == [("first", 1, 2, "a", ["a"]), ("first", 2, 3, "a", ["a"]), ("first", 3, 1, "a", ["a", "b"]), ("other", 1, 4, "z", ["z"])]
    assert signals.today(spark.createDataFrame([], EVENT), {"look": [("first", ["a"])]}, big=1).count() == 0


def test_screens_overlap_and_null_is_false(spark):
    got = signals.screened(spark.createDataFrame([(1, 5), (2, None)], "s int, v int"), {"high": F.col("v") > 3, "odd": F.col("v") % 2 == 1}).collect()
    assert sorted((r.preset, r.s) for r in got) == [("high", 1), ("odd", 1)]


def test_confidence_and_floors(spark):
    df = spark.createDataFrame([(1, "high"), (2, "low"), (3, None)], "i int, confidence string")
    kept, left = signals.confident(df, {"low": 1, "medium": 2, "high": 3})
    assert [r.i for r in kept.collect()] == [1] and left.first().left_out == 2
    assert [r.i for r in signals.floored(spark.createDataFrame([(1, -9.0, None), (2, 1.0, -0.5), (3, 1.0, None)], "i int, net double, largest_pct double"), 5, 0.25).collect()] == [1, 2]


def test_float_pct_needs_both_denominators(spark):
    df = spark.createDataFrame([(10.0, 1000.0, 50.0), (10.0, None, 50.0), (10.0, 1000.0, 0.0)], "v double, m double, p double")
    assert [r.f for r in df.select(signals.float_pct(F.col("v"), F.col("m"), F.col("p")).alias("f")).collect()] == [2.0, None, None]


def test_accumulation_names_the_largest_net_buyers(spark):
    rows = [(1, "a", "BUY", 5.0), (1, "b", "BUY", 9.0), (1, "c", "SELL", 2.0), (2, "a", "BUY", 1.0), (3, "a", "SELL", 1.0)]
    deals = spark.createDataFrame(rows, "security int, client string, side string, value double").withColumn("day", F.lit("2024-01-05").cast("date"))
    size = spark.createDataFrame([(1, 100.0), (2, 10_000.0), (3, 100.0)], "security int, market_cap double")
    got = signals.accumulation(deals, size, F.lit("2024-01-10").cast("date"), 30, below=1000, names=1).collect()
    assert [(r.security, r.net, r.pct, r.net_buyers) for r in got] == [(1, 12.0, 12.0, "b")]


def test_renamed_securities_are_one_to_one(spark):
    schema = "house string, security string, name string"
    before = spark.createDataFrame([("h", "A", "x"), ("h", "B", "y"), ("h", "C", "y"), ("g", "A", "x"), ("h", "K", "k")], schema)
    now = spark.createDataFrame([("h", "A2", "x"), ("h", "B2", "y"), ("g", "A2", "x"), ("h", "K", "k")], schema)
    renames = holdings.renamed_securities(now, before, "house", "security", "name")
    assert [tuple(r) for r in renames.collect()] == [("A", "A2")]
    assert {r.security for r in holdings.on_new_names(before, renames, "security").collect()} == {"A2", "B", "C", "K"}


def test_expected_and_share_factors(spark):
    rows = [("s", "Bonus", D(2024, 1, 5), 1.0, 1.0, None, None), ("s", "bonus", D(2024, 1, 5), 1.0, 1.0, None, None), ("s", "split", D(2024, 1, 5), None, None, 10.0, 5.0), ("t", "dividend", D(2024, 1, 5), None, None, None, None), (None, "split", D(2024, 1, 5), None, None, 10.0, 5.0)]
    factors = holdings.expected_factors(spark.createDataFrame(rows, "security string, purpose string, ex_day date, new_for double, held double, face_from double, face_to double"))
    assert {(r.security, r.expected and round(r.expected, 9), r.split_bonus) for r in factors.collect()} == {("s", 0.25, True), ("t", None, False)}
    day = lambda d: F.lit(d).cast("date")
    assert [round(r.factor, 9) for r in holdings.share_factors(factors, day("2024-01-04"), day("2024-01-05")).collect()] == [4.0]
    assert holdings.share_factors(factors, day("2024-01-05"), day("2024-01-09")).count() == 0


def test_clean_ratios(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (0.667,), (1.0,), (0.617,), (None,), (0.88,), (1 / 15,), (10 / 17,), (0.73,), (5 / 9,), (20.2,)], "f double")
    assert [r.c for r in df.select(holdings.is_clean_ratio(F.col("f")).alias("c")).collect()] == [True, True, True, False, True, False, False, True, True, False, True, True]


def test_missing_session_and_bridge(spark):
    bars = spark.range(40).select(F.when(F.col("id") < 30, "2024-01-02").otherwise("2024-01-03").cast("date").alias("day"), F.when(F.col("id") % 15 > 0, 0.9).otherwise(1.0).alias("base"))
    assert [r.day for r in holdings.missing_previous_session(bars, "day", F.col("base")).collect()] == [D(2024, 1, 2)]
    prints = [("x", "IN1A", D(2024, 1, 1)), ("x", "IN1A", D(2024, 1, 3)), ("x", "IN1B", D(2024, 1, 5)), ("x", "IN9C", D(2024, 1, 7)), ("y", "IN1A", D(2024, 1, 1)), ("y", "IN1B", D(2024, 3, 1))]
    got = holdings.bridged(spark.createDataFrame(prints, "symbol string, security string, day date"), F.substring("security", 1, 3))
    assert [tuple(r) for r in got.collect()] == [("x", "IN1A", "IN1B")]


def test_quarters_are_null_where_a_check_fails(spark):
    rows = [("s", D(2024, 3, 31), "match", 10.0, 5.0), ("s", D(2024, 6, 30), None, 11.0, 5.0), ("s", D(2024, 9, 30), "match", 13.0, None), ("s", D(2023, 12, 31), "match", 1.0, 1.0)]
    got = holdings.by_quarter(spark.createDataFrame(rows, "security string, q date, ok string, a double, b double"), "security", "q", F.col("ok") == "match", {"a": ["a"], "all": ["a", "b"]}, quarters=3)
    assert {(r.q.month, r.label, r.pct, r.change) for r in got.collect()} == {(3, "a", 10.0, None), (3, "all", 15.0, None), (6, "a", None, None), (6, "all", None, None), (9, "a", 13.0, 3.0), (9, "all", None, None)}


def test_ledger_takes_each_event_once(spark):
    schema = "signal string, security int, day date"
    events = spark.createDataFrame([("a", 1, D(2024, 1, 5)), ("a", 1, D(2024, 1, 5)), ("a", 2, D(2024, 1, 1)), ("b", 1, D(2024, 1, 6))], schema)
    ledger = spark.createDataFrame([("b", 1, D(2024, 1, 6))], schema)
    got = holdings.ledger_rows(events, ledger, ["signal", "security"], "day", F.lit("2024-01-03").cast("date"), F.lit("2024-01-07").cast("date"))
    assert [(r.signal, r.security) for r in got.collect()] == [("a", 1)]


def test_stage_links_and_supersession_without_pairs(spark):
    later = spark.createDataFrame([(1, "k", D(2024, 6, 1)), (2, "k", D(2024, 2, 1)), (3, "m", D(2024, 6, 1)), (4, None, D(2024, 6, 1)), (5, "k", None)], "l int, k string, d date")
    earlier = spark.createDataFrame([(7, "k", D(2024, 1, 5)), (8, "k", D(2024, 5, 1)), (9, "m", D(2023, 1, 1)), (7, "k", D(2024, 1, 6)), (None, "k", D(2024, 5, 30))], "e int, k string, t date")
    got = linkage.link_stages(later, earlier, "k", "l", "d", "e", "t").collect()
    assert {(r.l, r.status, r.linked) for r in got} == {(1, "ambiguous", None), (2, "linked", 7), (3, "none", None), (4, "none", None), (5, "none", None)}
    rows = [(1, "k", 1, False), (2, "k", 2, True), (3, "k", 2, False), (4, "k", 3, True), (5, None, 1, False), (6, None, 2, True), (7, "m", 1, True)]
    out = dedup.superseded_by_single(spark.createDataFrame(rows, "id int, k string, t int, rev boolean"), ["k"], "id", "t", "rev").collect()
    assert {(r.id, r.status, r.original) for r in out} == {(2, "replaces", 1), (4, "ambiguous", None), (6, "no_original", None), (7, "no_original", None)}


def test_forward_lookup_of_a_hot_key_stays_linear(spark):
    n = 20_000
    left = spark.range(n).select(F.lit("k").alias("k"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("t"), "id")
    right = left.select("k", F.col("t").alias("d"), F.col("id").alias("v")).where("v % 3 = 0")
    got = linkage.asof_join(left, right, ["k"], "t", "d", ["v"], direction="forward").agg(F.sum(F.col("v") - F.col("id")), F.count("v")).first()
    assert tuple(got) == (n - 2, n - 1)


def test_partitions_are_written_by_few_tasks(spark, tmp_path):
    df = spark.range(100).select(F.lit("2024-02-01").cast("date").alias("day"), "id")
    archive.write_partitioned(df, str(tmp_path / "a"), "day", spread=4)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.count() == 100 and len(back.inputFiles()) <= 4


def test_blocks_name_three_and_count_all(spark):
    rows = [("d", p, 1.04, 1.0) for p in "edcba"] + [("d", "a", 1.0, 1.0), ("d", None, 1.0, 1.0), ("e", "a", 1.0, 1.0)]
    got = trades.blocks(spark.createDataFrame(rows, "k string, p string, price double, q double"), ["k"], "p", "price", "q").collect()
    assert [(r.k, r.persons, r.quantity, r.named) for r in got] == [("d", 5, 7.0, ["a", "b", "c"])]
