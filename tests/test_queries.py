"""Each registered query against its SQL, and operators on small tables with nulls, ties and empty input."""

from __future__ import annotations

import datetime as dt

import pytest
from comparing import rows
from pyspark.sql import functions as F

from tidewater import queries
from tidewater.functions import names, values
from tidewater.operators import archive, dedup, documents, linkage, periods, prices, trades
from tidewater.streaming import windows

D = dt.date


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(name, spark, folder, oracle):
    got = queries.QUERIES[name](spark, folder)
    want = oracle.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_latest_first_keeps_one_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    kept, removed = dedup.latest_first(df, ["k"], [F.desc("v")])
    assert sorted(r.v for r in kept.collect()) == [2, 3]
    assert [(r.v, r.reason) for r in removed.collect()] == [(1, "duplicate")]


def test_reasons_report_bounds_examples(spark):
    report = dedup.reasons_report(spark.range(100).withColumn("reason", F.lit("x")), "t", "id").first()
    assert (report.n, report.examples) == (100, list(range(25)))


def test_asof_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([(1, "a", D(2024, 1, 10)), (2, "a", None), (3, None, D(2024, 1, 10)), (4, "b", D(2024, 1, 1))], "id int, k string, t date")
    right = spark.createDataFrame([("a", D(2024, 1, 10), 5), ("a", D(2024, 1, 1), 7), ("b", D(2024, 1, 2), 9), (None, D(2024, 1, 1), 1)], "k string, d date, v int")

    def got(**how):
        return {r.id: r.v for r in linkage.asof_join(left, right, ["k"], "t", "d", ["v"], **how).collect()}

    assert got() == {1: 5, 2: None, 3: None, 4: None}
    assert got(strict=True) == {1: 7, 2: None, 3: None, 4: None}
    assert got(strict=True, tolerance_days=5)[1] is None
    assert got(direction="forward") == {1: 5, 2: None, 3: None, 4: 9}
    assert got(direction="nearest") == {1: 5, 2: None, 3: None, 4: 9}


def test_asof_empty_right(spark):
    left = spark.createDataFrame([(1, "a", D(2024, 1, 1))], "id int, k string, t date")
    right = spark.createDataFrame([], "k string, d date, v int")
    assert linkage.asof_join(left, right, ["k"], "t", "d", ["v"]).first().v is None


def test_unique_match_or_nothing(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "l int, k string")
    b = spark.createDataFrame([(7, "x"), (8, "y")], "r int, k2 string")
    assert [tuple(r) for r in linkage.unique_match(a, b, F.col("k") == F.col("k2"), "l", "r").collect()] == [(1, 7)]


def test_spacing_depends_on_kept(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 10, 21, 22, 43, 44)], "k string, n long")
    assert sorted(r.n for r in prices.spaced(df, ["k"], "n", 21).collect()) == [1, 22, 43]


def test_adjusted_close_uses_later_factors_only(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, d), 100.0) for d in (1, 2, 3)], "k string, d date, c double")
    factors = spark.createDataFrame([("a", D(2024, 1, 2), 0.5), ("a", D(2024, 1, 3), 0.5), ("a", D(2024, 1, 3), -1.0)], "k string, d date, factor double")
    assert [round(r.adjusted, 9) for r in prices.adjusted_close(bars, factors, "k", "d", "c").orderBy("d").collect()] == [25.0, 50.0, 100.0]


def test_price_ladder_first_reason(spark):
    df = spark.createDataFrame([(10.0,), (1000.0,), (0.1,), (2.0,), (7.0,), (13.0,), (9.7,), (10.5,), (None,)], "p double")
    ladder = prices.price_ladder(F.col("p"), F.lit(10.0), F.lit(10.2), F.lit(None))
    assert [r.s for r in df.select(ladder.alias("s")).collect()] == ["inside", "power_of_ten", "power_of_ten", "face_value", "far_below", "far_above", "below", "above", "no_price"]


def test_period_changes_kinds(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("w", 4)], "k string, n int")
    b = spark.createDataFrame([("y", 3), ("z", 1), ("w", 4), ("v", 1)], "k string, n int")
    assert {r.k: r.kind for r in periods.period_changes(b, a, ["k"], "n").collect()} == {"x": "exit", "y": "added", "z": "cut", "w": "held", "v": "new"}


def test_merge_twice_changes_nothing(spark):
    new = spark.createDataFrame([("a", 1, "j"), ("b", 2, None)], "k string, v int, raw string")
    day, later = F.lit(D(2024, 1, 1)), F.lit(D(2024, 1, 1))
    empty = spark.createDataFrame([], "k string, v int, raw string, first_seen date, last_seen date")
    once = archive.merge(empty, new, ["k"], day, ["raw"])
    assert sorted(map(tuple, archive.merge(once, new, ["k"], later, ["raw"]).collect())) == sorted(map(tuple, once.collect()))


def test_net_two_way_drops_level_days(spark):
    df = spark.createDataFrame([("a", "BUY", 5), ("a", "SELL", 5), ("b", "BUY", 5), ("b", "SELL", 2)], "k string, side string, q int")
    assert [(r.k, r.side, r.net) for r in trades.net_two_way(df, ["k"], "side", "q").collect()] == [("b", "BUY", 3)]


def test_values_and_names(spark):
    row = spark.range(1).select(
        values.number(F.lit("(1,234.5)")).alias("n"), values.number(F.lit("x")).alias("bad"), values.flag(F.lit("False")).alias("f"), names.entity_key(F.lit("The A &amp; B Pvt. Ltd.")).alias("k"),
        names.entity_key(F.lit("Ltd")).alias("nothing"), values.fiscal_quarter(F.lit(D(2024, 4, 1))).alias("q"), names.first_pattern(F.lit(" "), [("a", "a")], None).alias("m"),
    ).first()
    assert tuple(row) == (-1234.5, None, False, "a-and-b", None, "FY2025Q1", "missing")


def test_documents_pages(spark):
    pages = "\f".join(f"Head {i}\nbody {'x' * i}\nFoot" for i in range(4))
    got = documents.furniture(spark.createDataFrame([(1, pages), (2, None), (3, "")], "d int, t string"), "d", "t")
    assert {r.line for r in got.collect()} == {"head #", "foot"}


def test_stream_merges_into_archive(spark, tmp_path):
    schema = "k string, day date, v int"
    source, target = str(tmp_path / "in"), str(tmp_path / "archive")
    spark.createDataFrame([("a", D(2024, 1, 5), 1), ("b", D(2024, 5, 5), 2)], schema).write.parquet(source)
    struct = spark.read.parquet(source).schema
    for run in range(2):
        query = windows.parquet_stream(spark, source, struct).writeStream.foreachBatch(windows.merge_into(target, ["k"], "day", struct)).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 2)]


def test_tumbling_stream_equals_batch(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.parquet_stream(spark, str(tmp_path / "in"), events.schema), "ts", "1 day", ["event_type"], "value")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("tumbled").collect())) == sorted(map(key, windows.tumbling(events, "ts", "1 day", ["event_type"], "value").collect()))
