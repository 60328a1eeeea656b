"""Figures of a group's results against plain Python."""

from __future__ import annotations

import random
import statistics

from tidewater.operators import results

SCHEMA = "sector string, security string, doubt string, half boolean, revenue double, revenue_growth double, profit double, profit_before double"


def middle(values):
    return statistics.median(values) if values else None


def test_figures_equal_plain_python(spark):
    """A hot sector, ties, nulls in every column, and a sector of doubts only."""
    turn = random.Random(3)
    rows = [(turn.choice(["hot", "hot", "hot", "b", "c", None]), f"s{n % 150}", turn.choice([None, None, "", "far"]), turn.choice([None, False, False, True]), turn.choice([None, 2e8, 5e8, 1e7]), turn.choice([None, -100.0, -20.0, 0.0, 10.0, float(n)]), turn.choice([None, -5.0, 0.0, 7.0, float(n)]), turn.choice([None, -2.0, 0.0, 4.0])) for n in range(300)]
    rows += [("doubts", "x", "far", False, 2e8, 5.0, 1.0, 1.0), ("few", "y", None, False, 2e8, 5.0, 1.0, 1.0)]
    table = results.compared(spark.createDataFrame(rows, SCHEMA))
    got = {r.sector: r for r in results.kpis(table, ["sector"]).collect()}
    rolled = {r.sector: r for r in results.rollup(table, ["sector"]).collect()}
    top = {}
    for r in results.movers(table, ["sector"], 3).collect():
        top.setdefault((r.sector, r.direction), []).append((r.place, r.security, r.revenue_growth))
    for sector in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == sector]
        sound = [r for r in mine if not r[2] and not r[3]]
        growth = [r[5] for r in sound if r[5] is not None]
        profit = [(r[6] / r[7] - 1) * 100 for r in sound if r[6] is not None and (r[7] or 0) > 0]
        g = got[sector]
        assert (g.reported, g.held, g.half) == (len({r[1] for r in mine}), sum(bool(r[2]) for r in mine), sum(not r[2] and bool(r[3]) for r in mine))
        assert (g.revenue_n, g.revenue_up, g.revenue_median) == (len(growth), sum(x > 0 for x in growth), middle(growth))
        assert (g.profit_n, g.profit_up, g.profit_median) == (len(profit), sum(x > 0 for x in profit), middle(profit))
        swings = [r for r in sound if r[6] is not None and r[7] is not None]
        assert (g.to_profit, g.to_loss, g.no_revenue) == (sum(r[7] < 0 <= r[6] for r in swings), sum(r[6] < 0 <= r[7] for r in swings), sum(r[4] is None for r in sound))
        assert (sector in rolled) == (sector is not None and len(growth) >= 3)
        if sector in rolled:
            assert (rolled[sector].companies, rolled[sector].compared, rolled[sector].revenue_up, rolled[sector].revenue_median) == (len({r[1] for r in sound}), len(growth), sum(x > 0 for x in growth), middle(growth))
        real = [r for r in sound if r[4] is not None and r[5] not in (None, 0.0, -100.0) and r[4] / (1 + r[5] / 100) >= 1e8]
        for direction, sign in (("grown", 1), ("shrunk", -1)):
            want = sorted((-sign * r[5], r[1]) for r in real if sign * r[5] > 0)[:3]
            assert sorted(top.get((sector, direction), [])) == [(i + 1, s, -sign * x) for i, (x, s) in enumerate(want)]


def test_empty_table(spark):
    none = results.compared(spark.createDataFrame([], SCHEMA))
    assert results.kpis(none, ["sector"]).count() == results.rollup(none, ["sector"]).count() == results.movers(none, ["sector"]).count() == 0
