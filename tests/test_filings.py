"""Cleaning of filings from end to end: each reason, pairs in row order, and counts that add up."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import filings

SCHEMA = """row_no long, exchange string, app_id string, prev_app_id string, submission string, symbol string, security string, person_raw string, role_raw string, mode_raw string, kind_raw string,
    quantity double, value double, held_before double, held_after double, day_from date, day_to date, seen timestamp, from_csv boolean"""
DAY = dt.date(2026, 6, 10)


def row(no, **other):
    made = {
        "row_no": no, "exchange": "nse", "app_id": str(no), "prev_app_id": None, "submission": None, "symbol": "SYM", "security": "INE1", "person_raw": f"Person Number {chr(65 + no % 26)}{chr(65 + no // 26)}", "role_raw": "Director", "mode_raw": "Market Purchase", "kind_raw": "Acquisition",
        "quantity": 100.0 + no, "value": 1000.0 * (100 + no), "held_before": 1000.0, "held_after": 1100.0 + no, "day_from": DAY, "day_to": DAY, "seen": dt.datetime(2026, 6, 12, 10) + dt.timedelta(minutes=no), "from_csv": False,
    }
    return tuple((made | other).values())


def cleaned(spark, rows, **how):
    return {r.row_no: r for r in filings.cleaned_filings(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()}


def test_each_reason_and_counts_that_add_up(spark):
    same = {"person_raw": "Anna Alder", "quantity": 500.0, "value": 5e6, "held_before": 10.0, "held_after": 510.0}
    rows = [
        row(1, **same), row(2, **same, prev_app_id="1", submission="Revision"),  # names what it replaces
        row(3, person_raw="Bo Birch"), row(4, person_raw="Bo Birch", quantity=9.0, value=900.0, held_after=1009.0, submission="Revision"),  # replaces by its mark
        row(5, person_raw="Bo Birch", exchange="bse", quantity=103.0, value=103000.0, held_after=1103.0),  # the copy of 3
        row(6, person_raw="Cy Cedar"), row(7, person_raw="Cy Cedar", quantity=106.0, value=106001.0, held_after=1106.0),  # the same but for a rounding
        row(8, person_raw="Di Dogwood", mode_raw="Market Sale"), row(9, person_raw="Di Dogwood", quantity=108.0, value=108000.0, held_after=1108.0),
        row(10, person_raw="Ed Elm", exchange="bse", app_id=None, from_csv=True), row(11, person_raw="Ed Elm", exchange="bse", app_id=None, seen=dt.datetime(2026, 6, 12, 10, 10), quantity=110.0, value=110000.0, held_after=1110.0, day_to=DAY + dt.timedelta(days=1)),
        row(12, person_raw="Fay Fir", held_before=5.0, held_after=117.0), row(13, person_raw="Fay Fir", quantity=112.0, value=112000.0, held_before=9.0, held_after=121.0),
        row(14, person_raw="Gus Gum"), row(15, person_raw="Gus Gum", quantity=114.0, value=114000.0, held_before=1114.0, held_after=1228.0),  # parts of one trade stay
        row(16, day_from=None, day_to=None), row(17, day_to=dt.date(2025, 1, 1)), row(18, person_raw=None, security=None, symbol=None, quantity=None, value=None, held_before=None, held_after=None, mode_raw=None, kind_raw=None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    stands, counts = filings.counted(filings.cleaned_filings(df, start=F.lit(dt.date(2025, 10, 8))), filings.REASONS, "filings-test")
    got = {r.row_no: r.reason for r in stands.collect()}
    assert {k: v for k, v in got.items() if v} == {
        1: "superseded_by_revision", 3: "superseded_by_revision_marker", 5: "copy_of_replaced_filing", 6: "repeat_filing", 8: "corrected_refiling", 11: "same_filing_two_feeds",
        12: "refiled_with_other_holdings", 16: "no_readable_transaction_date", 17: "before_product_start",
    }
    assert counts["rows"] == len(rows) == counts["kept"] + counts["unknown"] + sum(counts[r] for r in filings.REASONS) and counts["unknown"] == 0
    report = {(r.measure, r.name): (r.n, r.examples) for r in filings.cleaning_report(stands, counts, "filings", "row_no").collect()}
    assert report["rows", "rows"] == (18, None) and report["removed", "repeat_filing"] == (1, [6]) and report["flagged", "unmatched_security"] == (1, None)


def test_kinds_sides_and_holdings(spark):
    got = cleaned(spark, [
        row(1, mode_raw="-", kind_raw="PLEDGE REVOKE"), row(2, mode_raw="Block Deal", kind_raw="Disposal"), row(3, mode_raw="Off Market", kind_raw=None), row(4, quantity=0.0, value=None, held_before=5.0, held_after=5.0),
        row(5, mode_raw="Something new"), row(6, role_raw="-", person_raw="Hal Hazel"), row(7, role_raw="Promoters Immediate Relative", person_raw="Hal Hazel"), row(8, held_after=90.0), row(9, value=0.0),
    ])
    assert {n: (r.kind, r.is_market, r.side) for n, r in got.items() if n < 6} == {1: ("pledge_revoke", False, None), 2: ("market", True, "SELL"), 3: ("off_market", False, None), 4: ("holding_only", False, None), 5: ("unrecognised", False, "BUY")}
    assert (got[6].role, got[6].role_source, got[7].role) == ("promoter_group", "other_filing", "promoter_group")
    assert {"holding_moves_against_side", "holding_change_differs_from_quantity"} <= set(got[8].flags) and got[9].flags == ["missing_or_zero_value"] and got[5].flags == ["unrecognised_mode"]


def test_a_chain_of_revisions_leaves_the_last(spark):
    person = {"person_raw": "Ira Iris", "submission": "Revision"}
    got = cleaned(spark, [row(1, person_raw="Ira Iris"), row(2, **person), row(3, **person), row(4, person_raw="Joy Juniper"), row(5, person_raw="Joy Juniper"), row(6, person_raw="Joy Juniper", submission="Revised"), row(7, person_raw="Kit Kapok", submission="Revision")])
    assert {n: r.reason for n, r in got.items() if r.reason} == {1: "superseded_by_revision_marker", 2: "superseded_by_revision_marker"}


def test_pledges_take_shares_from_the_other_exchange(spark):
    pledge = {"person_raw": "Lee Larch", "mode_raw": "Pledge", "kind_raw": None, "value": None, "held_before": 7.0, "held_after": 7.0}
    blank = pledge | {"mode_raw": None, "exchange": "bse", "quantity": 40.0}
    rows = [row(1, **pledge, quantity=None), row(2, **pledge, quantity=None, day_from=dt.date(2026, 6, 8)), row(3, **blank), row(4, **pledge | {"exchange": "bse", "quantity": 30.0}), row(5, **blank | {"quantity": 9.0, "day_from": dt.date(2026, 7, 1), "day_to": dt.date(2026, 7, 1)}), row(6, **pledge, quantity=None, day_from=dt.date(2026, 5, 1), day_to=dt.date(2026, 5, 2))]
    got = cleaned(spark, rows)
    assert {n: (r.quantity, r.kind) for n, r in got.items()} == {1: (30.0, "pledge_create"), 2: (40.0, "pledge_create"), 3: (40.0, "pledge_create"), 4: (30.0, "pledge_create"), 5: (9.0, "missing"), 6: (None, "pledge_create")}
    assert {n: r.primary_no for n, r in got.items() if r.primary_no} == {4: 1, 3: 2}


def test_transfers_inside_a_group_pair_one_to_one(spark):
    side = lambda no, who, sells, price, **other: row(no, person_raw=who, role_raw="Promoter Group", mode_raw="Market Sale" if sells else "Market Purchase", kind_raw="Disposal" if sells else "Acquisition", quantity=1000.0, value=1000.0 * price, held_before=5000.0, held_after=4000.0 if sells else 6000.0, **other)
    got = cleaned(spark, [
        side(1, "Mia Maple", False, 100.0), side(2, "Ned Neem", True, 101.9), side(3, "Ona Oak", True, 98.1), side(4, "Pat Pine", False, 96.5), side(5, "Mia Maple", True, 100.0),
        side(6, "Quin Quince", False, 50.0), side(7, "Quin Quince", True, 50.0), side(8, "Ray Rowan", False, 50.0, day_from=dt.date(2026, 6, 9)), side(9, "Sue Sorrel", True, 51.5),
    ])
    assert {n for n, r in got.items() if r.group_transfer} == {1, 2, 3, 4}
    assert got[1].kind == "inter_se" and not got[1].is_market and got[6].is_market


def test_copies_on_the_other_exchange(spark):
    rows = [row(n, person_raw="Tom Teak", quantity=5.0, value=50.0 + 100 * n, held_before=float(n), held_after=n + 5.0, day_from=DAY - dt.timedelta(days=n)) for n in (1, 2, 3)]
    rows += [row(10 + n, exchange="bse", person_raw="Tom Teak", quantity=5.0, value=50.0 + 100 * n, held_before=float(n), held_after=n + 5.0, day_from=DAY - dt.timedelta(days=2), day_to=DAY - dt.timedelta(days=2)) for n in (1, 2)]
    rows += [row(20, exchange="bse", person_raw="Tom Teak", quantity=5.0, value=950.0, from_csv=True, day_from=None)]
    got = cleaned(spark, rows)
    assert {n: r.primary_no for n, r in got.items() if r.primary_no} == {11: 2, 12: 3, 20: 1}


def test_no_filings(spark):
    stands, counts = filings.counted(filings.cleaned_filings(spark.createDataFrame([], SCHEMA)), filings.REASONS, "none")
    assert stands.count() == 0 and counts["rows"] == counts["kept"] == 0


def test_only_rows_that_may_be_repeats_are_sorted(spark):
    """Keys that stand once take no part in looking for the first of a key; a null in a key is a value like others."""
    rows = [("a", None, 1, None), ("a", None, 2, None), ("a", "x", 3, None), ("b", None, 4, None), ("b", None, 5, "gone")]
    got = filings.repeats(spark.createDataFrame(rows, "k string, l string, row_no long, reason string"), ["k", "l"], F.struct("row_no")).collect()
    assert sorted((r.row_no, r.first.row_no) for r in got) == [(1, 2), (2, 2)]


def test_whole_filings_are_written_few_times(spark, tmp_path, monkeypatch):
    """Steps settle the numbers that they found; rows with all columns are written four times, however many steps there are."""
    wide = []

    def settled(df, label):
        wide.extend([label] if {"person_raw", "held_after"} <= set(df.columns) else [])
        path = str(tmp_path / f"{label}-{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(filings, "settled", settled)
    filings.cleaned_filings(spark.createDataFrame([], SCHEMA))
    assert len(wide) <= 4


def tables(folder):
    return sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir())


def test_tables_of_a_workshop_go_when_it_ends(spark, tmp_path, monkeypatch):
    """What is settled inside goes, what is kept stands in the workshop around, and a shuffle's files go with the write that made them."""
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    dropped = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(dropped, None)
    with session.workshop(spark) as outer:
        with session.workshop(spark) as inner:
            first = session.settled(spark.range(10), "first")
            second = inner(first.groupBy("id").count(), "second")
        assert tables(tmp_path) == ["second"]
        third = outer(second.select("id"), "third")
    assert tables(tmp_path) == ["third"] and third.count() == 10
    with pytest.raises(ZeroDivisionError), session.workshop(spark):
        session.settled(spark.range(10), "lost")
        raise ZeroDivisionError
    assert tables(tmp_path) == ["third"] and spark.conf.get(dropped, None) == before


def test_cleaned_filings_leave_what_they_are_read_from(spark, tmp_path, monkeypatch):
    """Of some forty settled tables only those stand in the end that the result reads; the report keeps one."""
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    rows = [row(i, quantity=float(1 + i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    with session.workshop(spark) as kept:
        cleaned = filings.cleaned_filings(df)
        left = tables(tmp_path)
        stands, counts = filings.counted(cleaned.select("row_no", "reason", "flags"), filings.REASONS, "report", kept)
    assert left == ["copies", "filings", "group-transfers", "removed", "removed"]
    assert tables(tmp_path) == ["report"] and stands.count() == counts["rows"] == 40
