"""XBRL facts, periods and groups on small filings of every odd shape."""

from __future__ import annotations

from tidewater.sources import xbrl


def context(name, first=None, last=None, instant=None, member=None):
    segment = f'<xbrli:segment><d:explicitMember xmlns:d="urn:d" dimension="x">in:{member}</d:explicitMember></xbrli:segment>' if member else ""
    period = f"<xbrli:instant>{instant}</xbrli:instant>" if instant else f"<xbrli:startDate>{first}</xbrli:startDate><xbrli:endDate> {last} </xbrli:endDate>"
    return f'<xbrli:context id="{name}"><xbrli:entity><xbrli:identifier scheme="s">x</xbrli:identifier>{segment}</xbrli:entity><xbrli:period>{period}</xbrli:period></xbrli:context>'


def fact(name, where, value, unit=None):
    return f'<in:{name} contextRef="{where}"{f" unitRef=\"{unit}\" decimals=\"-5\"" if unit else ""}>{value}</in:{name}>'


def filing(*parts):
    return '﻿<?xml version="1.0" encoding="UTF-8"?>\n<!-- note -->\n<xbrli:xbrl xmlns:xbrli="urn:x" xmlns:in="urn:in">' + "\n".join(parts) + "</xbrli:xbrl>"


END = "DateOfEndOfReportingPeriod"
Q2, H1 = ("2031-07-01", "2031-09-30"), ("2031-04-01", "2031-09-30")
BOTH = filing(
    context("OneD", *Q2), context("FourD", *H1), context("At", instant="2031-09-30"), context("Part", *Q2, member="Segment"), fact(END, "OneD", Q2[1]), fact(END, "FourD", H1[1]),
    fact("Revenue", "OneD", "67883400000", "INR"), fact("Revenue", "FourD", "131665200000", "INR"), fact("Revenue", "Part", "5", "INR"), fact("Assets", "At", "9.5", "INR"), fact("Name", "OneD", "A &amp; B\n Ltd"), fact("Shares", "OneD", "about ten", "shares"),
    '<in:Nil contextRef="OneD"/>', fact("Blank", "OneD", "  "), fact("Lost", "Nowhere", "x"), "<in:NoContext>1</in:NoContext>", '<xbrli:unit id="INR"><xbrli:measure>iso:INR</xbrli:measure></xbrli:unit>',
)
#: The period is stated in a context of its own, the lines in another of the same days.
APART = filing(context("Static", *Q2), context("Lines", *Q2), fact(END, "Static", Q2[1]), fact("OtherRevenue", "Lines", "7", "INR"), fact("Profit", "Lines", "2", "INR"), fact("Profit", "Static", "3", "INR"))
HALF = filing(context("OneD", *H1), fact(END, "OneD", H1[1]), fact("Revenue", "OneD", "4", "INR"))
GROUPS = filing(context("MainI", *Q2), fact("Total", "MainI", "3"), fact("Name", "D_Allottees2", "Two"), fact("Name", "I_allottees1", "One"), fact("Held", "Allottees1", "5"), fact("Name", "Allottees10", "Ten"), fact("Name", "Option1", "No"))


def read(spark):
    rows = [("both", BOTH), ("apart", APART), ("half", HALF), ("groups", GROUPS), ("null", None), ("empty", ""), ("text", "no xml <at all"), ("none", "<a/>")]
    return xbrl.xbrl_facts(spark.createDataFrame(rows, "filing string, xml string"), "filing", "xml").cache()


def test_facts_and_their_contexts(spark):
    got = {(r.filing, r.context, r.fact): r for r in read(spark).collect()}
    revenue = got["both", "OneD", "Revenue"]
    assert (revenue.first, revenue.last, revenue.instant, revenue.dimension, revenue.number, revenue.unit) == (*Q2, False, False, 67883400000.0, "INR")
    assert got["both", "Part", "Revenue"].dimension and got["both", "At", "Assets"].instant and got["both", "At", "Assets"].last == "2031-09-30"
    assert got["both", "OneD", "Name"].text == "A & B\n Ltd" and got["both", "OneD", "Name"].number is None
    assert (got["both", "OneD", "Shares"].text, got["both", "OneD", "Shares"].number) == ("about ten", None)
    assert got["both", "Nowhere", "Lost"].first is None
    assert {f for n, _, f in got if n == "both"} == {END, "Revenue", "Assets", "Name", "Shares", "Lost"} and {n for n, _, _ in got} == {"both", "apart", "half", "groups"}


def test_quarter_and_year_to_date(spark):
    got = {r.filing: (r.quarter, r.ytd, r.ytd_first, r.period_end) for r in xbrl.reporting_periods(read(spark), "filing").collect()}
    assert got == {"both": ("OneD", "FourD", "2031-04-01", "2031-09-30"), "apart": ("Static", None, None, "2031-09-30"), "half": (None, "OneD", "2031-04-01", "2031-09-30")}
    same = spark.createDataFrame([("x", BOTH.replace("2031-04-01", "2031-07-01"))], "filing string, xml string")
    one = xbrl.reporting_periods(xbrl.xbrl_facts(same, "filing", "xml"), "filing").first()
    assert one.quarter in ("OneD", "FourD") and one.ytd is None


def test_values_of_the_same_days(spark):
    facts = read(spark)
    got = {r.filing: r for r in xbrl.period_values(facts, xbrl.reporting_periods(facts, "filing"), "filing", {"revenue": ["Revenue", "OtherRevenue"], "profit": ["Profit"]}).collect()}
    assert (got["both"].quarter_revenue, got["both"].ytd_revenue, got["both"].quarter_profit) == (67883400000.0, 131665200000.0, None)
    assert (got["apart"].quarter_revenue, got["apart"].quarter_profit, got["apart"].ytd_revenue) == (7.0, 3.0, None)
    assert (got["half"].quarter_revenue, got["half"].ytd_revenue) == (None, 4.0)


def test_numbered_groups(spark):
    got = xbrl.numbered_groups(read(spark), "filing", "Allottees").orderBy("number", "fact").collect()
    assert [tuple(r) for r in got] == [("groups", 1, "Held", "5"), ("groups", 1, "Name", "One"), ("groups", 2, "Name", "Two"), ("groups", 10, "Name", "Ten")]


def test_results_filings_are_parsed_once(spark, folder):
    """Periods and values read settled facts: no parse is left in the plan."""
    from tidewater import queries

    plan = queries.QUERIES["results_summary"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml" not in plan.lower() and "xmltostructs" not in plan.lower()
