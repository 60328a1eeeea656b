"""Steps that deal their rows out once, in so many tasks that none holds much of a large table."""

from __future__ import annotations

import datetime as dt

from tidewater.bindings import filings
from tidewater.operators import holdings, linkage, replay, signals
from tidewater.session import FINER

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def tasks(df):
    return df.rdd.getNumPartitions()


def finer(spark):
    return FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_spans_judged_by_their_dates_pass_by_the_join(spark):
    spans = [(1, "a", 0, 31), (2, "a", 0, 32), (3, "a", 5, 4), (4, "a", None, 4), (5, "a", 40, 45), (6, None, 0, 9), (7, "b", 3, 3), (8, "a", 31, 31)]
    bars = [("a", 0, 5.0, 9.0), ("a", 31, 4.0, 6.0), ("a", 32, 1.0, 99.0), ("b", 3, 2.0, 2.5), (None, 3, 0.1, 0.2)]
    left = spark.createDataFrame([(i, k, day(a), day(b)) for i, k, a, b in spans], "row_id int, k string, first date, last date")
    right = spark.createDataFrame([(k, day(d), lo, hi) for k, d, lo, hi in bars], "k string, day date, low double, high double")
    out = linkage.span_stats(left, right, "k", "row_id", "first", "last", "day", "low", "high")
    assert {tuple(r) for r in out.collect()} == {
        (1, 4.0, 9.0, 2, "ok"), (2, None, None, 0, "span_too_long"), (3, None, None, 0, "dates_out_of_order"), (4, None, None, 0, "no_dates"),
        (5, None, None, 0, "no_session"), (6, None, None, 0, "no_session"), (7, 2.0, 2.5, 1, "ok"), (8, 4.0, 6.0, 1, "ok"),
    }
    # only days and bars are joined, and spans not once more with what they met
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_buys_before_sorts_in_finer_tasks(spark):
    rows = [("s", "p", "BUY", day(0)), ("s", "p", "SELL", day(3)), ("s", "p", "BUY", day(13)), ("s", "p", "BUY", day(14)), ("s", None, "BUY", day(1)), ("t", "p", "BUY", None)]
    out = signals.buys_before(spark.createDataFrame(rows, "security string, person string, side string, day date"), ["security", "person"], "day")
    assert sorted((r.security, str(r.person), str(r.day), r.buys) for r in out.collect()) == [("s", "None", "2024-01-02", 1), ("s", "p", "2024-01-01", 1), ("s", "p", "2024-01-04", 1), ("s", "p", "2024-01-14", 2), ("s", "p", "2024-01-15", 2), ("t", "p", "None", 1)]
    assert tasks(out) == finer(spark)


def test_expected_factors_shuffle_once(spark):
    rows = [("s", "Bonus", day(0), 1.0, 1.0, None, None), ("s", "bonus", day(0), 1.0, 1.0, None, None), ("s", "split", day(0), None, None, 10.0, 2.0), ("s", "dividend", day(1), None, None, None, None), (None, "bonus", day(0), 1.0, 1.0, None, None)]
    out = holdings.expected_factors(spark.createDataFrame(rows, "security string, purpose string, ex_day date, new_for double, held double, face_from double, face_to double"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and tasks(out) == finer(spark)
    assert sorted((r.security, str(r.ex_day), r.expected and round(r.expected, 9), r.split_bonus) for r in out.collect()) == [("s", "2024-01-01", 0.1, True), ("s", "2024-01-02", None, False)]


def test_finer_filings_are_the_same(spark, folder):
    whole, fine = filings(spark, folder), filings(spark, folder, finer=True)
    assert tasks(fine) == finer(spark) and sorted(map(str, fine.collect())) == sorted(map(str, whole.collect()))


def test_heavy_days_deal_a_persons_rows_once(spark):
    rows = [("s", "p", day(0), 0.1), ("s", "p", day(10), 0.1), ("s", "p", day(31), 0.06), ("s", "q", day(31), 0.1), ("s", "q", day(40), None)]
    buys = spark.createDataFrame(rows, "security string, person string, day date, pct double")
    out = replay.heavy_days(buys, buys.select("security", "day"), "security", "person", "day", "pct")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(security#") <= 5 and "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.security, str(r.day)) for r in out.collect()} == {("s", "2024-01-11"), ("s", "2024-02-01")}
