"""Rows on the edge of a rule: whole seconds, exact balances, and sums that come about by chance."""

from __future__ import annotations

import datetime as dt

import duckdb
from comparing import rows

from tidewater import queries
from tidewater.operators import cleaning, periods, prices, trades, transfers

D = dt.date


def test_sessions_part_by_whole_seconds(spark):
    at = [dt.datetime(2024, 1, 6, 22, 16, 14, 740464), dt.datetime(2024, 1, 6, 22, 46, 14, 77845), dt.datetime(2024, 1, 6, 23, 16, 13, 999999)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "k int, id int, t timestamp_ntz")
    got = sorted((r.start, r.end, r.n) for r in periods.sessions_by_gap(df, "k", "t", "id", 30).collect())
    assert got == [(at[0], at[0], 1), (at[1], at[2], 2)]


def test_a_maker_right_at_the_balance(spark):
    # 0.1 + 0.2 is above 0.3 in doubles, so that half of it is not reached by 0.15
    legs = spark.createDataFrame([("a", D(2024, 1, 1), "BUY", 0.15), ("a", D(2024, 1, 2), "SELL", 0.1), ("a", D(2024, 1, 3), "SELL", 0.2), ("b", D(2024, 1, 1), "BUY", 0.14), ("b", D(2024, 1, 1), "SELL", 0.3)], "p string, day date, side string, q double")
    ends = spark.createDataFrame([(D(2024, 1, 7),)], "period_end date")
    got = trades.market_makers(legs, "p", "day", "side", "q", ends, days=7, least_legs=2, balance=0.5).collect()
    assert [(r.p, r.buy, r.sell) for r in got] == [("a", 0.15, 0.3)]


def test_table_checks_end_the_schedule_at_its_total(spark, tmp_path):
    # one line of 45,000 in a misread table: all rows above its total income make just that; and a price that the two before it make
    prices = {7: [45_000.0], 8: [100.0, 200.0, 300.0, 1000.0], 14: [90_000.0], 21: [5.0, 7.5]}
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame([(k, p) for k, found in prices.items() for p in found], "l_orderkey long, l_extendedprice double").write.parquet(path)
    got = queries.QUERIES["table_checks"](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    want = base.sql(queries.ORACLE_SQL["table_checks"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_names_never_go_through_the_driver(spark):
    # a small file of names stands for very many of them: no size that Spark takes from it may lead to a broadcast
    cut = spark.createDataFrame([("x", "ramesh-kumar-agarw", "r"), ("x", "ramesh-kumar-agarwal", "r")], "s string, p string, raw string")
    merged = cleaning.merged_cut_names(cut, "s", "p", "raw")
    assert {r.p: r.merged for r in merged.collect()}["ramesh-kumar-agarw"] == "ramesh-kumar-agarwal"
    assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()


def test_lookups_of_placements_carry_no_names(spark):
    # buyers of a price are as many as a day has: a row for each sale must not hold them all
    day = D(2024, 1, 1)
    deals = [(i, None, "S", day, 10.0, 100.0 + i % 2 * 0.03, "BUY", f"C{i:02d}", False) for i in range(9)] + [(90 + i, None, "S", day, 10.0, 100.0, "SELL", "P", True) for i in range(3)]
    deals = spark.createDataFrame(deals, "deal_id long, pair long, security string, day date, quantity double, price double, side string, client_name string, client_is_promoter boolean")
    assert transfers.placed_sales(deals).columns == ["security", "quantity", "day", "turn", "price"]
    told = spark.createDataFrame([(1, "S", 10.0, "SELL", "market", "promoter", day, day, True, 7.0, "own"), (2, "S", 11.0, "SELL", "market", "promoter", day, day, True, 7.0, "own")], "id int, security string, quantity double, side string, kind string, role string, day_from date, day_to date, is_market boolean, price double, day string")
    got = {r.id: (r.placement_buyers, r.price, r.day) for r in transfers.insider_transfers(told, deals).collect()}
    assert got == {1: ([f"C{i:02d}" for i in range(9)], 7.0, "own"), 2: (None, 7.0, "own")}


def test_prints_are_not_multiplied_by_horizons(spark):
    days = [D(2024, 1, d) for d in range(1, 8)]
    sessions = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "day date, session_no int")
    bars = spark.createDataFrame([("a", days[i], 100.0 + i) for i in (1, 2, 4)] + [("a", days[2], 101.0), ("b", days[3], 7.0)], "k string, d date, c double")
    events = spark.createDataFrame([(1, "a", days[0]), (2, "a", days[1]), (3, "a", days[2]), (4, "b", days[2]), (5, None, days[0])], "id int, k string, d date")
    out = prices.forward_returns(events, bars, sessions, "k", "d", "c", horizons=(1, 2, 3), cost=0.0)
    got = {r.id: (r.entry, *(None if r[f"r_{n}"] is None else round(101.0 * (1 + r[f"r_{n}"] / 100), 6) for n in (1, 2, 3))) for r in out.collect()}
    assert got == {1: (101.0, 102.0, None, 104.0), 2: (102.0, None, round(101.0 * 104 / 102, 6), None), 3: (None,) * 4, 4: (7.0, None, None, None), 5: (None,) * 4}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
