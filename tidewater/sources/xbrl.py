"""Facts of XBRL filings as rows, by one parse into a nested schema; reporting periods, values of a period, and numbered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a document is parsed into. Facts have names of their own; :func:`_named_facts` turns those into an attribute first.
SCHEMA = """context array<struct<_id: string, period: struct<startDate: string, endDate: string, instant: string>,
    entity: struct<segment: struct<explicitMember: array<string>>>, scenario: struct<explicitMember: array<string>>>>,
    fact array<struct<_name: string, _contextRef: string, _unitRef: string, _VALUE: string>>"""

#: Days that a quarter has at most.
QUARTER_DAYS = 100


def _named_facts(xml: Column) -> Column:
    """Elements that refer to a context, whatever they are called, as ``<fact name="...">``; a byte order mark and the declaration go."""
    body = F.regexp_replace(F.regexp_replace(xml, "^\\s*﻿?\\s*", ""), r"^<\?xml[^>]*\?>", "")
    return F.regexp_replace(body, r"(?s)<((?:[\w.-]+:)?([\w.-]+))((?:\s[^<>]*)?\scontextRef\s*=[^<>]*)(?<!/)>(.*?)</\1\s*>", r'<fact name="$2"$3>$4</fact>')


def xbrl_facts(filings: DataFrame, filing: str, xml: str) -> DataFrame:
    """(filing, context, first, last, instant, dimension, fact, text, number, unit): one row a fact with a value.

    ``first`` and ``last`` are a context's start and end as filed (ISO days), ``last`` its instant where it
    has no end; ``dimension`` says that the context is of a member. A number is a value with a unit that
    reads as one. Names are without prefixes. A fact whose context is not declared has no period; filings
    that are null, empty or no XML give no rows.
    """
    parsed = filings.select(F.col(filing), F.from_xml(_named_facts(F.col(xml)), SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "valueTag": "_VALUE"}).alias("x"))
    members = lambda c, where: F.coalesce(F.size(c[where]["explicitMember"] if where == "scenario" else c["entity"]["segment"]["explicitMember"]), F.lit(0))
    period = lambda c: F.named_struct(
        F.lit("first"), F.trim(c["period"]["startDate"]), F.lit("last"), F.trim(F.coalesce(c["period"]["endDate"], c["period"]["instant"])), F.lit("instant"), c["period"]["instant"].isNotNull(),
        F.lit("dimension"), members(c, "segment") + members(c, "scenario") > 0,
    )
    contexts = F.transform("x.context", lambda c: F.named_struct(F.lit("id"), c["_id"], F.lit("of"), period(c)))
    rows = parsed.select(filing, contexts.alias("contexts"), F.explode("x.fact").alias("f"))
    # a filing has tens of contexts: each fact looks its own up in its filing's list
    own = F.get(F.filter("contexts", lambda c: c["id"] == F.col("f._contextRef")), F.lit(0))["of"]
    text = F.trim(F.col("f._VALUE"))
    told = rows.where(F.col("f._contextRef").isNotNull() & (F.length(text) > 0)).select(filing, F.col("f._contextRef").alias("context"), own.alias("of"), F.col("f._name").alias("fact"), text.alias("text"), F.when(F.col("f._unitRef").isNotNull(), text.try_cast("double")).alias("number"), F.col("f._unitRef").alias("unit"))
    return told.select(filing, "context", "of.first", "of.last", F.coalesce("of.instant", F.lit(False)).alias("instant"), F.coalesce("of.dimension", F.lit(False)).alias("dimension"), "fact", "text", "number", "unit")


def reporting_periods(facts: DataFrame, filing: str, end_fact: str = "DateOfEndOfReportingPeriod", quarter_days: int = QUARTER_DAYS) -> DataFrame:
    """(filing, quarter, quarter_first, ytd, ytd_first, period_end): the contexts of a filing's quarter and of its year to date.

    Plain durations (no member, no instant) that report a period's end: of those with the latest end, the
    quarter starts latest and the year to date earliest, if earlier. A single one of more than
    ``quarter_days`` days is the year to date, and there is no quarter. Of contexts with the same days the
    last name is the quarter and the first the year to date.
    """
    plain = facts.where(~F.col("instant") & ~F.col("dimension") & F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("fact") == end_fact)).select(filing, "context", "first", "last").distinct()
    latest = plain.groupBy(filing).agg(F.max("last").alias("last"))
    ends = plain.join(latest, [filing, "last"]).groupBy(filing, "last").agg(F.max(F.struct("first", "context")).alias("late"), F.min(F.struct("first", "context")).alias("early"))
    days = F.coalesce(F.datediff(F.col("last").try_cast("date"), F.col("late.first").try_cast("date")), F.lit(0))
    long, other = days > quarter_days, F.col("early.first") < F.col("late.first")
    return ends.select(
        filing, F.when(~long, F.col("late.context")).alias("quarter"), F.when(~long, F.col("late.first")).alias("quarter_first"),
        F.when(long, F.col("late.context")).when(other, F.col("early.context")).alias("ytd"), F.when(long, F.col("late.first")).when(other, F.col("early.first")).alias("ytd_first"), F.col("last").alias("period_end"),
    )


def period_values(facts: DataFrame, periods: DataFrame, filing: str, lines: dict[str, list[str]]) -> DataFrame:
    """One row a filing of ``periods`` with ``quarter_<line>`` and ``ytd_<line>``: the number of the first of a line's facts that is filed, else null.

    A fact counts for a period in its own context, or else in another plain context of the same days (some
    filings state the period in a context of its own), of these the first by name.
    """
    wanted = [f for names in lines.values() for f in names]
    plain = facts.where(~F.col("instant") & ~F.col("dimension") & F.col("fact").isin(wanted) & F.col("number").isNotNull()).select(filing, "context", "first", "last", "fact", "number")
    joined = plain.join(periods, filing)

    def found(period: str, names: list[str]) -> Column:
        same = (F.col("first") == F.col(f"{period}_first")) & (F.col("last") == F.col("period_end"))
        rank = F.struct(F.array_position(F.array(*map(F.lit, names)), F.col("fact")), F.col("context") != F.col(period), "context")
        return F.min_by(F.when(same & F.col("fact").isin(names), F.col("number")), F.when(same & F.col("fact").isin(names), rank))

    values = joined.groupBy(filing).agg(*(found(p, names).alias(f"{p}_{line}") for p in ("quarter", "ytd") for line, names in lines.items()))
    return periods.join(values, filing, "left")


def numbered_groups(facts: DataFrame, filing: str, prefix: str) -> DataFrame:
    """(filing, number, fact, text): facts of the contexts ``prefix1``, ``prefix2``, ... (a D_ or I_ before it dropped, case ignored); of repeated facts the one of the last context name."""
    number = F.regexp_extract("context", rf"(?i)^(?:[DI]_)?{prefix}([0-9]+)$", 1)
    rows = facts.withColumn("number_text", number).where("number_text <> ''").select(filing, F.col("number_text").cast("int").alias("number"), "fact", "text", "context")
    last = Window.partitionBy(filing, "number", "fact").orderBy(F.desc("context"), F.desc("text"))
    return rows.withColumn("at", F.row_number().over(last)).where("at = 1").select(filing, "number", "fact", "text")
