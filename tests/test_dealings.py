"""Cleaning of deals, and tables of text that add up, on small frames of odd rows."""

from __future__ import annotations

import datetime as dt
import random

from tidewater.operators import dealings, filings, tables

SCHEMA = "row_id long, exchange string, feed string, from_csv boolean, security string, symbol string, client string, side string, quantity double, price double, day date, round_trip boolean"
DAY = dt.date(2026, 5, 4)


def deal(row_id, client, side, quantity, price=10.0, **other):
    made = {"row_id": row_id, "exchange": "nse", "feed": "bulk", "from_csv": True, "security": "INE1", "symbol": "SYM", "client": client, "side": side, "quantity": quantity, "price": price, "day": DAY, "round_trip": None}
    return tuple((made | other).values())


def cleaned(spark, rows):
    out = dealings.deal_rows(spark.createDataFrame(rows, SCHEMA).repartition(3)).cache()
    return {r.row_id: r for r in out.collect()}, {r.leg_id: r for r in dealings.deal_legs(out).collect()}


def test_rows_go_for_their_reasons(spark):
    rows, legs = cleaned(spark, [
        deal(1, "a", "BUY", 5.0, round_trip=True), deal(2, "a", "BUY", 5.0), deal(3, "a", "BUY", 5.0, from_csv=False), deal(4, "a", "BUY", 5.0, 10.004, from_csv=False), deal(5, "a", "BUY", 5.0, 11.0, from_csv=False),
        deal(6, "b", "SELL", 7.0), deal(7, "b", "SELL", 7.0, feed="block"),
        deal(8, "c", "SELL", 50.0), deal(9, "c", "SELL", 30.0, 10.5, feed="block"), deal(10, "c", "SELL", 19.0, 10.6, feed="block"),
        deal(11, "d", "SELL", 50.0), deal(12, "d", "SELL", 30.0, 10.5, feed="block"), deal(13, "d", "SELL", 21.0, 10.6, feed="block"),
        deal(14, None, None, None, None, security=None, symbol=None, day=None, feed=None), deal(15, "a", "BUY", 5.0, exchange="bse"),
    ])
    assert {n: r.reason for n, r in rows.items() if r.reason} == {
        1: "intraday_round_trip", 3: "same_deal_in_older_form", 4: "same_deal_in_older_form", 6: "same_trade_in_both_feeds", 9: "block_legs_inside_bulk_total", 10: "block_legs_inside_bulk_total", 11: "block_legs_inside_bulk_total",
    }
    assert rows[7].feeds == rows[8].feeds == rows[12].feeds == ["block", "bulk"]
    assert {n: (r.quantity, r.trades, r.twin) for n, r in legs.items()} == {2: (10.0, 2, False), 15: (5.0, 1, False), 7: (7.0, 1, False), 8: (50.0, 1, False), 12: (51.0, 2, False), 14: (None, 1, False)}
    assert abs(legs[2].price - 10.5) < 1e-9 and legs[14].flags == ["unmatched_security", "missing_price_or_quantity", "missing_side"]


def test_copies_in_both_feeds_are_found_by_hash(spark):
    """Sums of numbers and flags alone, which are not sorted; a removed row is told the feeds of its copies too."""
    made = dealings.deal_rows(spark.createDataFrame([deal(1, "a", "BUY", 5.0), deal(2, "a", "BUY", 5.0, from_csv=False), deal(3, "a", "BUY", 5.0, feed="block"), deal(4, "b", "BUY", 5.0, round_trip=True), deal(5, "c", "BUY", 5.0, feed=None), deal(6, "c", "BUY", 5.0)], SCHEMA))
    assert "SortAggregate" not in (plan := made._jdf.queryExecution().sparkPlan().toString()) and "ObjectHashAggregate" not in plan
    assert {r.row_id: (r.reason, r.feeds) for r in made.collect()} == {
        1: ("same_trade_in_both_feeds", ["block", "bulk"]), 2: ("same_deal_in_older_form", ["block", "bulk"]), 3: (None, ["block", "bulk"]), 4: ("intraday_round_trip", None), 5: (None, ["bulk"]), 6: ("same_trade_in_both_feeds", ["bulk"]),
    }


def test_legs_are_netted_or_go(spark):
    maker = [deal(1000 + 2 * i + k, "maker", side, 10.0 + i, 9.0 + i, security=f"S{i}") for i in range(20) for k, side in enumerate(("BUY", "SELL"))] + [deal(1100 + i, "maker", "BUY", 3.0, security=f"T{i}") for i in range(2)]
    rows, legs = cleaned(spark, [
        *maker, deal(1, "a", "BUY", 100.0), deal(2, "a", "SELL", 99.5, exchange="bse"), deal(3, "b", "BUY", 100.0), deal(4, "b", "SELL", 40.0), deal(5, "b", "SELL", 10.0, exchange="bse"),
        deal(6, "c", "BUY", 5.0, security="X"), deal(7, "d", "SELL", 5.0, 10.004, security="X"), deal(8, "e", "BUY", 6.0, security="X"), deal(9, "f", "SELL", 6.0, 10.1, security="X"),
        deal(10, "g", "BUY", 8.0, security="X"), deal(11, "h", "SELL", 8.0, security="X"), deal(12, "i", "SELL", 8.0, security="X"), deal(13, "j", "BUY", 9.0), deal(14, "j", "BUY", 9.0, exchange="bse"),
    ])
    assert {n: r.reason for n, r in legs.items() if r.reason and n < 1000} == {1: "intraday_round_trip_across_exchanges", 2: "intraday_round_trip_across_exchanges", 4: "same_day_both_sides_netted", 5: "same_day_both_sides_netted"}
    assert (legs[3].quantity, legs[3].value, legs[3].two_way_bought, legs[3].two_way_sold) == (50.0, 500.0, 100.0, 50.0)
    assert all(r.is_maker == (r.client == "maker") for r in legs.values())
    assert {n: r.pair_leg for n, r in legs.items() if r.pair_leg and n < 1000} == {6: 7, 7: 6} and legs[13].twin and legs[14].twin and not legs[6].twin


def test_counterparties_are_real_ones_first(spark):
    rows = [("nse", "S", DAY, "BUY", "a", 5.0, False, None), ("nse", "S", DAY, "BUY", "b", 9.0, False, None), ("nse", "S", DAY, "BUY", "m", 90.0, True, None), ("nse", "S", DAY, "BUY", "gone", 99.0, False, "x"), ("nse", "S", DAY, "SELL", "c", 1.0, False, None)]
    legs = spark.createDataFrame(rows, "exchange string, security_key string, day date, side string, client string, value double, is_maker boolean, reason string")
    assert {r.side: r.counterparties for r in dealings.first_counterparties(legs, 2).collect()} == {"SELL": "b; a", "BUY": "c"}


def test_no_deals(spark):
    rows = dealings.deal_rows(spark.createDataFrame([], SCHEMA))
    assert rows.count() == 0 and dealings.deal_legs(rows).count() == 0
    stands, counts = filings.counted(rows, dealings.ROW_REASONS, "no-deals")
    assert counts["rows"] == 0 and stands.count() == 0


GOOD = """I Revenue from operations 310.50 356.75 284.23
II Other income 20.25 29.15 5.17

III Total income (I + II) 330.75 385.90 289.40
IX Profit / (loss) before tax 71.70 44.16 (3.96)
X Tax expense / (credit):
Total tax expense / (credit) 8.20 9.92 (0.50)
XI Profit / (loss) for the period / year (IX-X) 63.50 34.24 (3.46)
"""


def test_results_tables_add_up(spark):
    loss = "1 Net Sales  1,000.00\n2 Other Income  10.00\n3 Total Income (1+2)  1,010.00\nProfit before tax (20.00)\nTotal tax expense -5.00\nNet profit after tax (15.00)\n"
    apart = "Revenue from operations 5\n" + "Line of text 1\n" * 9 + "Other income 1\nTotal income 6\n"
    rows = [("good", GOOD), ("bad", GOOD.replace("330.75", "830.75").replace("63.50", "68.50")), ("few", "Revenue from operations 8,932 8,355\nProfit after tax 1,351 1,510\n"), ("loss", loss), ("off", loss.replace("1,010.00", "1,012.03")), ("apart", apart), ("null", None), ("empty", "")]
    got = sorted((r.doc, r.rule, r.total, r.parts, r.holds) for r in tables.table_arithmetic(spark.createDataFrame(rows, "doc string, text string"), "doc", "text").collect())
    assert got == [
        ("bad", "income", 830.75, 330.75, False), ("bad", "profit", 68.5, 63.5, False), ("good", "income", 330.75, 330.75, True), ("good", "profit", 63.5, 63.5, True),
        ("loss", "income", 1010.0, 1010.0, True), ("loss", "profit", -15.0, -15.0, True), ("off", "income", 1012.03, 1010.0, False), ("off", "profit", -15.0, -15.0, True),
    ]


def test_grids_and_the_rows_that_add_up(spark):
    text = "Holding of:\n a) Alder 1,672.50 67.45\n b) Birch 92.25 3.74\n c) Cedar (10.00) 0.00\nTotal (a+b+c) 1,754.75 71.19\nOther 5 5\nSum of two 1,759.75 76.19\nNo amounts here\n"
    grid = tables.number_grid(spark.createDataFrame([("x", text), ("y", None)], "doc string, text string"), "doc", "text")
    assert {(r.line, r.column): r.amount for r in grid.collect()} == {(1, 0): 1672.5, (1, 1): 67.45, (2, 0): 92.25, (2, 1): 3.74, (3, 0): -10.0, (3, 1): 0.0, (4, 0): 1754.75, (4, 1): 71.19, (5, 0): 5.0, (5, 1): 5.0, (6, 0): 1759.75, (6, 1): 76.19}
    found = {(r.line, r.column): (r.first_line, r.rows) for r in tables.adding_rows(grid, "doc").collect()}
    assert found == {(4, 0): (1, 3), (4, 1): (1, 3), (6, 0): (4, 2), (6, 1): (4, 2)}


def test_adding_rows_equal_all_runs(spark):
    rng = random.Random(5)
    rows = [(d, line, "label", 0, float(rng.choice([-2, -1, 0, 1, 2, 3, 5]))) for d in range(12) for line in range(25)]
    got = {(r.doc, r.line): (r.first_line, r.rows) for r in tables.adding_rows(spark.createDataFrame(rows, "doc int, line int, label string, column int, amount double"), "doc").collect()}
    want = {}
    for d in range(12):
        v = [r[4] for r in rows if r[0] == d]
        for i in range(25):
            for n in range(2, i + 1):
                if v[i] and sum(v[i - n : i]) == v[i]:
                    want[d, i] = (i - n, n)
                    break
    assert got == want
