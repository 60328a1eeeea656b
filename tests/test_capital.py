"""Events of capital at their floors, with nulls and repeats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import capital

TOTAL = [("A", 1000.0), ("B", 1000.0), ("C", 0.0)]


def ref():
    return F.lit("2024-06-30").cast("date")


def day(n):
    return dt.date(2024, 6, 30) + dt.timedelta(n)


def shares(spark):
    return spark.createDataFrame(TOTAL, "security string, total double")


def seen(df):
    return sorted((r.security, r.list, r.kind, round(r.pct, 6), r.value, r["last"]) for r in df.collect())


def test_shares_of_the_latest_quarter_that_states_them(spark):
    rows = [("A", day(0), None), ("A", day(-90), 5.0), ("A", day(-180), 9.0), ("B", day(0), 2.0), ("B", day(0), 3.0), (None, day(0), 1.0)]
    got = capital.latest_shares(spark.createDataFrame(rows, "security string, quarter_end date, total_shares double"))
    assert sorted(map(tuple, got.collect())) == [("A", 5.0), ("B", 3.0)]


def test_promoters_deals_without_a_filing(spark):
    rows = [("A", "SELL", 3.0, 30.0, day(-1)), ("A", "BUY", 1.0, 10.0, day(-3)), ("A", "SELL", 500.0, 1.0, day(-90)), ("B", "SELL", 9.0, 9.0, day(0)), ("C", "SELL", 9.0, 9.0, day(0)), ("D", "BUY", 9.0, 9.0, day(0)), (None, "BUY", 9.0, 9.0, day(0)), ("E", "BUY", 0.4, 9.0, day(0))]
    deals = spark.createDataFrame(rows, "security string, side string, quantity double, value double, day date")
    filed = spark.createDataFrame([("B", day(1)), ("A", day(-90)), ("A", day(2)), (None, day(0))], "security string, day date")
    more = shares(spark).union(spark.createDataFrame([("E", 1000.0)], "security string, total double"))
    assert seen(capital.promoter_deal_events(deals, filed, more, ref())) == [("A", "warn", "promoter_deal_sale", 0.2, 20.0, day(-1))]
    assert capital.promoter_deal_events(deals.limit(0), filed, more, ref()).count() == 0


def test_issues_to_promoters_and_their_part_of_mixed_ones(spark):
    rows = [
        (1, "A", "PROMOTER", 0.0, 50.0, 99.0, 7.0, day(1)), (2, "A", "MIXED", -5.0, None, 40.0, 7.0, day(0)), (3, "A", "MIXED", 5.0, 40.0, None, 7.0, day(0)), (4, "A", "MIXED", 5.0, 40.0, None, None, day(-89)),
        (5, "A", "NON_PROMOTER", 5.0, 40.0, None, 7.0, day(0)), (6, "A", "PROMOTER", None, 40.0, None, 7.0, day(0)), (7, None, "PROMOTER", 1.0, 40.0, None, 7.0, day(0)), (8, "C", "PROMOTER", 1.0, 40.0, None, 7.0, day(0)), (9, "A", "PROMOTER", 1.0, 40.0, None, 7.0, day(-90)), (10, "A", "PROMOTER", 1.0, 40.0, None, 7.0, None),
    ]
    issues = spark.createDataFrame(rows, "app_id int, security string, category string, vs_market double, allotted double, proposed double, amount double, day date")
    parts = capital.promoter_parts(spark.createDataFrame([(2, 30.0, True), (2, 10.0, None), (3, 5.0, False), (9, None, True), (None, 5.0, True)], "app_id int, securities double, in_promoter_group boolean"))
    assert seen(capital.issue_events(issues, parts, shares(spark), ref())) == sorted([
        ("A", "look", "promoters_pay_up", 5.0, 7.0, day(1)), ("A", "warn", "cheap_shares_to_promoters", 3.0, 7.0, day(0)), ("A", "look", "promoters_pay_up", 4.0, None, day(-89)), ("C", "look", "promoters_pay_up", 0.0, 7.0, day(0)),
    ])


def test_tender_buybacks_well_above_the_price(spark):
    rows = [("A", "tender", 10.0, 20.0, 5.0, None, day(-89)), ("A", "tender", 9.9, 20.0, 5.0, day(0), None), ("A", "open market", 50.0, 20.0, 5.0, day(0), None), ("B", "tender", 12.0, None, None, day(40), day(-200)), ("A", "tender", 12.0, 1.0, 1.0, None, None), ("A", "tender", 12.0, 1.0, 1.0, day(-90), day(0))]
    got = capital.buyback_events(spark.createDataFrame(rows, "security string, route string, vs_market double, sought double, offer_value double, opens date, record_day date"), shares(spark), ref())
    assert seen(got) == [("A", "look", "buyback_at_premium", 2.0, 5.0, day(-89)), ("B", "look", "buyback_at_premium", 0.0, None, day(40))]


def test_raises_by_amount_or_dilution(spark):
    done = "Allotted or listed"
    rows = [
        ("A", "qip", done, None, None, day(-1), 100e7, None), ("A", "rights", done, None, day(-2), day(-200), None, 20.0), ("A", "preferential", done, "PROMOTER", day(0), None, 200e7, None), ("A", "preferential", done, "MIXED", day(0), None, 1.0, 499.0), ("A", "qip", done, None, day(0), None, 1.0, 500.0),
        ("A", "qip", "Approved", None, day(0), None, 200e7, None), ("A", "qip", done, None, day(0), None, 99e7, 19.0), (None, "qip", done, None, day(0), None, 200e7, None), ("A", "preferential", done, None, day(0), None, 200e7, None), ("C", "qip", done, None, day(0), None, -1.0, 500.0),
    ]
    got = capital.raise_events(spark.createDataFrame(rows, "security string, source string, status string, category string, allotted_on date, posted_on date, amount double, allotted double"), shares(spark), ref())
    assert seen(got) == [("A", "look", "raise_preferential", 49.9, 1.0, day(0)), ("A", "look", "raise_qip", 0.0, 100e7, day(-1)), ("A", "look", "raise_rights", 2.0, None, day(-2))]
