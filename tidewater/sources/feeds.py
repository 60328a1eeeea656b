"""Feeds as declared layouts: delimited files and JSON records read as typed columns, with counts of what breaks their rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.values import number


@dataclass(frozen=True)
class Layout:
    """File columns -> (column, kind: text, number or day), and how days are written. Optional columns may be absent."""

    columns: dict[str, tuple[str, str]]
    day: str
    optional: tuple[str, ...] = ()


# Column names and date shapes of the feeds.
PRICE_DAY = Layout(
    {
        "TradDt": ("day", "day"), "Src": ("exchange", "text"), "ISIN": ("security", "text"), "TckrSymb": ("symbol", "text"), "SctySrs": ("series", "text"), "OpnPric": ("open", "number"), "HghPric": ("high", "number"),
        "LwPric": ("low", "number"), "ClsPric": ("close", "number"), "PrvsClsgPric": ("prev_close", "number"), "TtlTradgVol": ("volume", "number"), "TtlTrfVal": ("value", "number"), "TtlNbOfTxsExctd": ("trades", "number"),
    },
    "yyyy-MM-dd",
)
MARKET_CAP = Layout(
    {"Trade Date": ("day", "day"), "Symbol": ("symbol", "text"), "Series": ("series", "text"), "Category": ("category", "text"), "Issue Size": ("issue_size", "number"), "Close Price/Paid up value(Rs.)": ("close", "number"), "Market Cap(Rs.)": ("market_cap", "number")},
    "dd MMM yyyy",
)
INDEX_CLOSE = Layout({"Index Name": ("symbol", "text"), "Index Date": ("day", "day"), "Closing Index Value": ("close", "number"), "P/E": ("pe", "number"), "P/B": ("pb", "number"), "Div Yield": ("dividend_yield", "number")}, "dd-MM-yyyy", ("P/E", "P/B", "Div Yield"))
BULK_DEALS = Layout(
    {"Date": ("day", "day"), "Symbol": ("symbol", "text"), "Client Name": ("client", "text"), "Buy / Sell": ("side", "text"), "Quantity Traded": ("quantity", "number"), "Trade Price / Wght. Avg. Price": ("price", "number"), "Remarks": ("remarks", "text")},
    "dd-MMM-yyyy",
    ("Remarks",),
)
BAND_LIST = Layout({"Symbol": ("symbol", "text"), "Series": ("series", "text"), "Band": ("band", "text"), "Remarks": ("remarks", "text")}, "dd-MM-yyyy", ("Remarks",))
ACTION_FIELDS = "symbol string, isin string, series string, subject string, exDate string, recDate string, faceVal string"
STAKE_FIELDS = "symbol string, acquirerName string, acqSaleType string, acqType string, promoterType string, noOfShareAcq string, noOfShareSale string, totAcqShare string, totSaleShare string, totAftShare string, timestamp string"
FLOW_FIELDS = "category string, date string, buyValue string, sellValue string, netValue string"
# What the subject of a filed action is for, the first that is found; a scheme's own bonus is a bonus.
PURPOSES = [
    ("buyback", r"buy\s*-?\s*back"),
    ("bonus", r"\bbonus\b"),
    ("split", r"split|sub-?division"),
    ("demerger", r"spin\s*-?\s*off|de-?merger"),
    ("capital_reduction", r"reduction\s+of\s+(?:share\s+)?capital|capital\s+reduction"),
    ("scheme", r"scheme\s+of\s+arrangement|amalgamation"),
    ("rights", r"\brights?\b"),
    ("dividend", r"dividend"),
]
# What a board meeting can be called for.
MEETING_FLAGS = {
    "results": r"financial\s+results|quarterly\s+results|audited|unaudited",
    "dividend": r"dividend",
    "buyback": r"buy\s*-?\s*back",
    "bonus": r"\bbonus\b",
    "fund_raising": r"fund\s*-?\s*rais|raising\s+of\s+funds|\bqip\b|qualified\s+institutions",
    "split": r"split|sub-?division",
    "rights": r"rights\s+issue",
    "preferential": r"preferential",
}


def read_layout(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """A delimited feed as typed columns: header names compared without case, marks and blanks; cells that do not parse are null.

    A required column that the file lacks is an error, an optional one is null.
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    known = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}
    missing = [c for c in layout.columns if c.lower() not in known and c not in layout.optional]
    if missing:
        raise ValueError(f"columns not in the file: {missing}")

    def cell(file_column: str, name: str, kind: str) -> Column:
        found = known.get(file_column.lower())
        text = F.lit(None).cast("string") if found is None else F.nullif(F.trim(F.col(f"`{found}`")), F.lit(""))
        if kind == "number":
            return number(text).alias(name)
        return (F.try_to_timestamp(text, F.lit(layout.day)).cast("date") if kind == "day" else text).alias(name)

    return raw.select(*[cell(c, name, kind) for c, (name, kind) in layout.columns.items()])


def action_terms(actions: DataFrame) -> DataFrame:
    """Filed actions with purpose (other if none is known), the terms that the subject states, and typed days.

    ``new_for`` and ``held`` of a bonus or rights ratio, ``face_from`` and ``face_to`` of a split, and the sum of a
    dividend's amounts per share; each null for other purposes.
    """
    subject = F.lower("subject")
    purpose = F.lit("other")
    for name, pattern in reversed(PURPOSES):
        purpose = F.when(subject.rlike(pattern), F.lit(name)).otherwise(purpose)
    amount = r"(?:rs|re)\.?\s*([0-9]+(?:\.[0-9]+)?)"

    def found(pattern: str, group: int, *purposes: str) -> Column:
        text = F.regexp_extract(F.coalesce(subject, F.lit("")), pattern, group)
        return F.when(F.col("purpose").isin(*purposes) & (text != ""), text.cast("double"))

    paid = F.aggregate(F.transform(F.regexp_extract_all(F.coalesce(subject, F.lit("")), F.lit(amount + r"\s*per\s*sh"), F.lit(1)), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("dd-MMM-yyyy")).cast("date")
    return actions.withColumn("purpose", purpose).select(
        "symbol", F.col("isin").alias("security"), "subject", "purpose", day("exDate").alias("ex_day"), day("recDate").alias("record_day"), number(F.col("faceVal")).alias("face_value"),
        found(r"([0-9]+)\s*:\s*([0-9]+)", 1, "bonus", "rights").alias("new_for"), found(r"([0-9]+)\s*:\s*([0-9]+)", 2, "bonus", "rights").alias("held"),
        found(rf"from\s+{amount}.*?to\s+{amount}", 1, "split").alias("face_from"), found(rf"from\s+{amount}.*?to\s+{amount}", 2, "split").alias("face_to"),
        F.when((F.col("purpose") == "dividend") & (paid > 0), paid).alias("dividend"),
    )


def meeting_flags(text: Column) -> list[Column]:
    """What a board meeting is called for, one flag a purpose; a null text has none."""
    return [F.coalesce(F.lower(text).rlike(pattern), F.lit(False)).alias(name) for name, pattern in MEETING_FLAGS.items()]


def stake_terms(stakes: DataFrame) -> DataFrame:
    """Disclosed stakes as (symbol, holder, instrument, is_promoter, shares and percents bought, sold and after, seen)."""
    return stakes.select(
        "symbol", F.col("acquirerName").alias("holder"), F.nullif(F.trim("acqType"), F.lit("")).alias("instrument"), F.coalesce(F.lower("promoterType").startswith("y") | F.lower("promoterType").startswith("promoter"), F.lit(False)).alias("is_promoter"),
        number(F.col("noOfShareAcq")).alias("shares_bought"), number(F.col("noOfShareSale")).alias("shares_sold"), number(F.col("totAcqShare")).alias("pct_bought"), number(F.col("totSaleShare")).alias("pct_sold"), number(F.col("totAftShare")).alias("pct_after"),
        F.try_to_timestamp(F.col("timestamp"), F.lit("dd-MMM-yyyy HH:mm")).alias("seen"),
    )


def flow_terms(flows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Market flows with typed values and whether buying less selling is the net that was printed; null where one is missing."""
    buy, sell, net = (number(F.col(c)) for c in ("buyValue", "sellValue", "netValue"))
    return flows.select(F.col("category"), F.try_to_timestamp(F.col("date"), F.lit("dd-MMM-yyyy")).cast("date").alias("day"), buy.alias("buy"), sell.alias("sell"), net.alias("net"), (F.abs(buy - sell - net) <= tolerance).alias("adds_up"))


def price_day_checks(day: DataFrame) -> DataFrame:
    """One row of counts: rows, no day, no security, no close, a close that is not positive, ranges that contradict themselves, and repeated keys."""
    traded = F.coalesce("volume", F.lit(0)) > 0
    bad = traded & ((F.col("high") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")))
    repeated = day.groupBy("security", "symbol", "series").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeated"))
    counts = day.agg(
        F.count("*").alias("rows"), F.count_if(F.col("day").isNull()).alias("no_day"), F.count_if(F.col("security").isNull()).alias("no_security"), F.count_if(F.col("close").isNull()).alias("no_close"),
        F.count_if(F.col("close") <= 0).alias("not_positive"), F.count_if(bad).alias("bad_range"),
    )
    return counts.crossJoin(repeated)


def market_cap_checks(caps: DataFrame) -> DataFrame:
    """One row of counts: rows, no day, no issue size, and market caps that are not issue size times close (1 percent, or one)."""
    gap = F.abs(F.col("issue_size") * F.col("close") - F.col("market_cap")) > 0.01 * F.abs("market_cap") + 1
    return caps.agg(F.count("*").alias("rows"), F.count_if(F.col("day").isNull()).alias("no_day"), F.count_if(F.col("issue_size").isNull()).alias("no_issue_size"), F.count_if(F.col("market_cap").isNotNull() & F.coalesce(gap, F.lit(True))).alias("off"))
