"""Decisions by decision-maker on small tables: the group as one, stakes, prior months and floors."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import decisions

REF = dt.date(2026, 6, 30)
SCHEMA = "turn int, security string, person int, role string, group_id string, side string, quantity double, value double, pct double, is_token boolean, seen date, day_from date, day_to date, held_before double"


def back(days):
    return REF - dt.timedelta(days=days)


def trade(turn, security, person, role, quantity, value, days_ago=5, **other):
    made = {"turn": turn, "security": security, "person": person, "role": role, "group_id": None, "side": "BUY", "quantity": quantity, "value": value, "pct": 0.01, "is_token": None, "seen": back(days_ago), "day_from": back(days_ago + 2), "day_to": back(days_ago + 1), "held_before": None}
    return tuple((made | other).values())


TRADES = [
    trade(1, "x", 1, "promoter", 100.0, 1e6, held_before=1000.0), trade(2, "x", 2, "director", 50.0, 5e5, group_id="g", held_before=500.0), trade(3, "x", 1, "promoter", 10.0, 1e5, 9, held_before=990.0),
    trade(4, "x", 3, "director", 20.0, 2e5), trade(5, "x", 3, "promoter", 5.0, 5e4, 3), trade(6, "x", 4, "employee", 999.0, 9e9), trade(7, "x", 1, "promoter", 1.0, 1.0, is_token=True), trade(8, "x", 5, "kmp", 1.0, 1.0, 90), trade(9, "x", 5, "kmp", 1.0, 1.0, -1),
    trade(10, "x", 6, "promoter_group", 1.0, 1.0, 100), trade(11, "x", 7, "promoter", 1.0, 1.0, 200), trade(12, "x", 3, "other", 1.0, 1.0, 130), trade(13, "x", 3, "other", 1.0, 1.0, 500),
    trade(14, None, 1, "promoter", 1.0, 1.0), trade(15, "y", None, "promoter", 1.0, 1.0), trade(16, "y", 9, "kmp", 7.0, 3e8, pct=0.2, side="SELL"), trade(17, "y", 8, "promoter", 30.0, 1e6, pct=0.3, side="SELL", day_from=None),
]
SHARES = [("x", 1, 10_000.0, 500.0), ("x", 2, None, 1000.0), ("y", 1, 0.0, None), (None, 1, 5.0, 5.0)]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(TRADES, SCHEMA).repartition(3), spark.createDataFrame(SHARES, "security string, quarter int, total_shares double, promoter_shares double")


def test_the_group_is_one_decision_maker(frames):
    got = {(r.security, r.maker): r for r in decisions.decisions_by_maker(*frames, F.lit(REF)).collect()}
    assert got.keys() == {("x", 1), ("x", 3)}
    group, officer = got["x", 1], got["x", 3]
    assert (group.by_group, group.value, group.quantity, group.persons, group.filings, group.days, group.roles) == (True, 1.6e6, 160.0, 2, 3, 2, ["director", "promoter"])
    assert group.own_change == pytest.approx(160 / 1490 * 100)  # the first trade of person 1 is the one of turn 3
    assert (group.group_change, group.pct, group.pct_basis, group.prior_months) == (16.0, 1.6, "shares", 2)
    # a filing as promoter makes the row the group's, but the person was first met as a director, and stands alone
    assert (officer.by_group, officer.quantity, officer.own_change, officer.persons) == (True, 25.0, None, 1)
    assert (group.first_day, group.last_day, group.trade_from, group.trade_to) == (back(9), back(5), back(11), back(6))
    assert group.avg_price == pytest.approx(1e4)


def test_sales_without_known_shares(frames):
    got = {r.maker: r for r in decisions.decisions_by_maker(*frames, F.lit(REF), side="SELL").collect()}
    assert {n: (r.pct, r.pct_basis, r.group_change, r.by_group) for n, r in got.items()} == {9: (0.2, "value", None, False), 8: (0.3, "value", None, True)}
    assert decisions.decisions_by_maker(frames[0].limit(0), frames[1], F.lit(REF)).count() == 0


def test_floors(spark):
    rows = [(25e5, 0.05, 1, True), (24e5, 0.05, 1, False), (25e5, 0.04, 1, False), (1.0, 0.25, 1, True), (1.0, 0.0, 10, True), (25e7, 0.0, 1, True), (None, None, None, False), (26e5, None, 1, False)]
    df = spark.createDataFrame(rows, "value double, pct double, days int, want boolean")
    assert [r.got for r in df.select(decisions.large_enough().alias("got")).collect()] == [r[3] for r in rows]


def test_two_lists(frames):
    trades, shares = frames
    look = {r.security: r for r in decisions.ideas(trades, shares, F.lit(REF)).collect()}
    assert look.keys() == {"x"} and (look["x"].makers, look["x"].lead, look["x"].kinds) == (2, 1, ["group_buying", "cluster"])
    warn = {r.security: r for r in decisions.cautions(trades, shares, F.lit(REF)).collect()}
    assert (warn["y"].kind, warn["y"].makers, warn["y"].value) == ("group_selling", 2, 3.01e8)
