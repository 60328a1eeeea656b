"""Insiders' trades beside deals, and disclosures of two exchanges, against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidewater import queries
from tidewater.operators import transfers, venues

T0 = dt.date(2024, 1, 1)
TRADES = "row int, security string, quantity double, side string, kind string, role string, day_from date, day_to date, is_market boolean"
DEALS = "deal_id int, pair int, security string, day date, quantity double, price double, side string, client_name string, client_is_promoter boolean"


def day(n):
    return None if n is None else T0 + dt.timedelta(n)


def marked(spark, trades, deals):
    out = transfers.insider_transfers(spark.createDataFrame(trades, TRADES), spark.createDataFrame(deals, DEALS)).collect()
    return {r.row: (r.kind, r.is_market, r.cross_with, r.group_transfer_by_deal, r.placement_buyers) for r in out}


def looped(trades, deals):
    """Each pair and placement against each trade, in order of day and number."""
    out = {t[0]: [t[4], t[8], None, False, None] for t in trades}
    span = lambda t: (t[6] or t[7], t[7])
    fits = lambda t, d: t[1] is not None and t[1] == d[2] and t[2] == d[4] and span(t)[1] is not None and span(t)[0] <= d[3] <= span(t)[1]
    subjects = [t for t in trades if t[4] == "market" and t[5] in transfers.INSIDER_ROLES and t[3] in ("BUY", "SELL")]
    pairs = {}
    for d in deals:
        if d[1] is not None:
            pairs.setdefault(d[1], []).append(d)
    whole = sorted((b[3], n, b, s, all(d[8] for d in legs)) for n, legs in pairs.items() for b in legs if b[6] == "BUY" for s in legs if s[6] == "SELL")
    for _, _, b, s, inside in whole:
        hit = [t for t in subjects if fits(t, b)]
        for t in hit:
            out[t[0]][2] = b[7] if t[3] == "SELL" else None
            if t[3] == "BUY":
                out[t[0]][2] = s[7]
        if inside and all(t[5] in transfers.GROUP_ROLES for t in hit):
            for t in hit:
                out[t[0]][:2], out[t[0]][3] = ["inter_se", False], True
    for s in sorted((d for d in deals if d[6] == "SELL" and d[8] and d[5] is not None), key=lambda d: (d[3], d[0])):
        buys = [d for d in deals if d[6] == "BUY" and not d[8] and d[2] == s[2] and d[3] == s[3] and d[5] is not None and abs(d[5] - s[5]) <= 0.0005 * s[5]]
        for t in subjects:
            if len(buys) >= 2 and t[3] == "SELL" and t[5] in transfers.GROUP_ROLES and out[t[0]][0] == "market" and out[t[0]][2] is None and fits(t, s):
                out[t[0]][4] = sorted({d[7] for d in buys if d[7]})
    return {k: tuple(v) for k, v in out.items()}


def test_a_pair_inside_the_group_is_a_transfer_and_others_are_crosses(spark):
    trades = [
        (1, "G", 40.0, "SELL", "market", "promoter", day(2), day(2), True), (2, "G", 40.0, "BUY", "market", "promoter_group", None, day(2), True), (3, "H", 10.0, "SELL", "market", "promoter", day(0), day(4), True),
        (4, "H", 10.0, "SELL", "market", "director", day(4), day(5), True), (5, "H", 10.0, "SELL", "off_market", "promoter", day(0), day(4), False), (6, None, 10.0, "SELL", "market", "promoter", day(0), day(4), True), (7, "K", 5.0, "SELL", "market", "promoter", day(1), day(3), True), (8, "K", 5.0, "BUY", "market", "kmp", day(2), day(2), True),
    ]
    deals = [
        (1, 1, "G", day(2), 40.0, 503.0, "BUY", "Sam", True), (2, 1, "G", day(2), 40.0, 503.0, "SELL", "Dan", True), (3, 2, "H", day(3), 10.0, 9.0, "BUY", "Infra", False), (4, 2, "H", day(3), 10.0, 9.0, "SELL", "Dan", True),
        (5, 3, "H", day(4), 10.0, 9.0, "SELL", "Alone", True), (6, 4, "K", day(2), 5.0, 1.0, "BUY", "A", True), (7, 4, "K", day(2), 5.0, 1.0, "SELL", "B", True),
    ]
    got = marked(spark, trades, deals)
    assert got[1] == ("inter_se", False, "Sam", True, None) and got[2] == ("inter_se", False, "Dan", True, None)
    assert got[3] == ("market", True, "Infra", False, None)
    assert [got[n][2] for n in (4, 5, 6)] == [None, None, None]
    assert got[7] == ("market", True, "A", False, None) and got[8][2] == "B"
    assert got == looped(trades, deals)


def test_a_sale_is_placed_with_buyers_at_its_price(spark):
    """Prices at, just inside and just outside the tolerance, on both sides; a promoter among the buyers; one buyer alone."""
    trades = [(n, s, 30.0, "SELL", "market", "promoter", day(1), day(3), True) for n, s in enumerate("VWXY")]
    deals = [(1, None, "V", day(2), 30.0, 160.0, "SELL", "Seller", True)] + [(2 + i, None, "V", day(2), 9.0 + i, p, "BUY", c, False) for i, (p, c) in enumerate([(160.0, "Rita"), (160.079, "Ann"), (159.921, "Paul"), (160.081, "Far"), (159.919, "Low"), (160.0, "Rita"), (160.0, None)])]
    deals += [(20, None, "V", day(2), 1.0, 160.0, "BUY", "Promoter", True), (21, None, "W", day(2), 30.0, 10.0, "SELL", "P", True), (22, None, "W", day(2), 30.0, 10.0, "BUY", "One", False), (23, None, "X", day(4), 30.0, 10.0, "SELL", "P", True), (24, None, "X", day(4), 3.0, 10.0, "BUY", "One", False), (25, None, "X", day(4), 3.0, 10.0, "BUY", "Two", False)]
    deals += [(26, None, "Y", day(3), 30.0, None, "SELL", "P", True), (27, None, "Y", day(1), 30.0, 0.0, "SELL", "P", True)]
    got = marked(spark, trades, deals)
    assert [got[n][4] for n in range(4)] == [["Ann", "Paul", "Rita"], None, None, None]


def test_marks_equal_a_loop_with_a_hot_key(spark):
    turn = random.Random(11)
    trades = [(n, turn.choice("AAAB"), float(turn.choice([5, 5, 5, 6, 7])), turn.choice(["BUY", "SELL", "SELL"]), turn.choice(["market", "market", "gift"]), turn.choice(["promoter", "promoter_group", "promoter", "director"]), turn.choice([None, day(turn.randrange(12))]), day(turn.randrange(5, 16)), True) for n in range(120)]
    deals = []
    for n in range(60):
        s, q, d, p = turn.choice("AB"), float(turn.choice([5, 6, 7])), day(turn.choice([3, 6, 9, 9, 12, 15])), turn.choice([10.0, 10.004, 10.006])
        pair = n if turn.random() < 0.15 else None
        deals.append((2 * n, pair, s, d, q, p, "BUY", f"c{turn.randrange(6)}", turn.random() < 0.5))
        deals.append((2 * n + 1, pair, s, d, q, p, "SELL", f"c{turn.randrange(6)}", turn.random() < 0.7))
    got = marked(spark, trades, deals)
    assert got == looped(trades, deals)
    assert len({v[0] for v in got.values()}) == 3 and any(v[4] for v in got.values())
    assert marked(spark, [], deals) == {} and all(v[2] is None for v in marked(spark, trades, []).values())


def test_clients_are_promoters_by_list_before_filing(spark):
    deals = spark.createDataFrame([(1, "A", "p1", None), (2, "A", "x", "alt"), (3, "A", "p2", None), (4, "B", "p1", None), (5, None, "p1", None), (6, "A", None, None), (7, "A", "p3", None), (8, "A", "p2", "alt")], "n int, security string, client_id string, client_alt_id string")
    members = spark.createDataFrame([("A", "p1", None), ("A", "m", "alt"), ("A", "p1", None)], "security string, member_id string, member_alt_id string")
    filed = spark.createDataFrame([("A", "p2", "promoter"), ("A", "p1", "promoter_group"), ("A", "p3", "director")], "security string, person_id string, role string")
    got = {r.n: r.client_promoter_basis for r in transfers.marked_promoters(deals, members, filed).collect()}
    assert got == {1: "promoter_group_list", 2: "promoter_group_list", 3: "pit_filing", 4: None, 5: None, 6: None, 7: None, 8: "promoter_group_list"}


def test_amounts_link_within_one_percent_or_one_share(spark):
    """Every pair of amounts around the bend of the tolerance, against the rule itself."""
    amounts = [0.0, 0.5, 1.0, 2.0, 50.0, 51.0, 98.5, 99.0, 99.5, 100.0, 100.5, 101.0, 101.01, 102.0, 990.0, 999.0, 1000.0, 1010.0, 1010.1, 1e6, 1.01e6, 1.0101e6, 1.02e6, -5.0, -5.5, None]
    rows = [(i, "S", a) for i, a in enumerate(amounts)]
    schema = "id int, security string, shares double"
    second = spark.createDataFrame([*rows, (99, None, 5.0)], schema)
    first = spark.createDataFrame([*rows, (98, None, 5.0), (97, "T", 1e6)], schema)
    got = {r.id: (r.first_event_id, r.listed_on) for r in venues.linked_to_first(second, first, ["security"], "id", "shares").collect()}
    for i, a in enumerate(amounts):
        fits = [j for j, b in enumerate(amounts) if a is not None and b is not None and abs(a - b) <= max(0.01 * abs(b), 1)]
        assert got[i] == ((min(fits), "second,first") if fits else (None, "second")), a
    assert got[99] == (None, "second") and len(got) == len(amounts) + 1


def test_links_without_amounts_and_one_table_of_both(spark):
    second = spark.createDataFrame([(1, "A", None, day(1)), (2, "A", "bonus", day(1)), (3, "A", "split", day(1)), (4, "A", "bonus", None)], "id int, security string, purpose string, day date")
    first = spark.createDataFrame([(7, "A", "bonus", day(1)), (6, "A", "bonus", day(1)), (8, "A", None, day(1)), (9, "A", "bonus", None)], "id int, security string, purpose string, day date")
    linked = venues.linked_to_first(second, first, ["security", "purpose", "day"], "id", nullable=("purpose",))
    assert {r.id: r.first_event_id for r in linked.collect()} == {1: 8, 2: 6, 3: None, 4: None}
    both = venues.of_both(first, linked)
    assert sorted((r.id, r.listed_on) for r in both.collect()) == [(3, "second"), (4, "second"), (6, "first"), (7, "first"), (8, "first"), (9, "first")]
    strict = venues.linked_to_first(second, first, ["security", "purpose", "day"], "id")
    assert {r.id: r.first_event_id for r in strict.collect()}[1] is None


def test_moved_meetings(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, "C", day(9), at(1), False), (2, "C", day(9), at(5), True), (3, "C", day(9), at(6), False), (4, "C", day(9), None, False), (5, "C", day(10), at(1), None), (6, "D", day(9), at(1), False), (7, "D", day(9), None, True), (8, None, day(9), at(1), False), (9, "C", day(9), at(2), True)]
    got = {r.id: r.reason for r in venues.without_moved(spark.createDataFrame(rows, "id int, code string, day date, intimated timestamp, moved boolean")).collect()}
    assert got == {1: "moved_away", 2: "moved", 3: None, 4: "moved_away", 5: None, 6: None, 7: "moved", 8: None, 9: "moved"}


def test_holdings_that_the_first_exchange_has_are_left_out(spark):
    second = spark.createDataFrame([("A", "a", 5.0), ("B", None, 5.0), ("C", "c", 5.0), ("D", None, None), (None, "e", 1.0)], "security string, first_symbol string, pct double")
    first = spark.createDataFrame([("A",), ("B",), (None,)], "security string")
    reasons = lambda table: {r.security: r.reason for r in venues.second_only(second, table).collect()}
    assert reasons(first) == {"A": "dual_listed_left_out", "B": "in_first_table_left_out", "C": None, "D": "not_parsed_yet", None: None}
    assert reasons(first.limit(0)) == {"A": "dual_listed_left_out", "B": None, "C": "dual_listed_left_out", "D": "not_parsed_yet", None: "dual_listed_left_out"}


@pytest.mark.parametrize("name", ["insider_transfers", "two_venue_stakes", "two_venue_meetings", "file_standings"])
def test_queries_are_registered_with_sql(name):
    assert name in queries.QUERIES and name in queries.ORACLE_SQL
