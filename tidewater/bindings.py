"""Roles of the sample tables: which columns play a filing, a deal, a price or a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import dealt
from tidewater.sources.files import table

REF = "1998-06-30"

#: The same roles in SQL, for the oracles.
FILINGS = """f AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS security, l_suppkey AS person, o_custkey AS second,
    CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, l_extendedprice AS value, l_tax AS tax, l_discount AS discount,
    CAST(o_orderdate AS DATE) AS day_from, CAST(l_shipdate AS DATE) AS day_to, l_linestatus AS status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DEALS = """d AS (SELECT event_id, user_id AS client, CAST(ts AS DATE) AS day, ts, event_type, CASE WHEN event_type IN (SELECT min(event_type) FROM events UNION ALL SELECT max(event_type) FROM events) THEN 'SELL' ELSE 'BUY' END AS side,
    value AS quantity, CAST(json_extract(props, '$.k') AS BIGINT) AS security FROM events)"""
BARS = """b AS (SELECT l_partkey AS security, CAST(l_shipdate AS DATE) AS day, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
    sum(l_quantity) AS quantity, sum(l_extendedprice) AS value, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""
SESSIONS = "s AS (SELECT day, row_number() OVER (ORDER BY day) AS session_no FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem))"


def filings(spark: SparkSession, folder: str, finer: bool = False) -> DataFrame:
    """Filed trades: line items with their orders; ``finer``: dealt out in more tasks, for queries that sort or sum them all by order."""
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("security"), F.col("l_suppkey").alias("person"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("value"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"), F.col("l_shipdate").cast("date").alias("day_to"), F.col("l_linestatus").alias("status"),
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("second"), F.col("o_orderdate").cast("date").alias("day_from"))
    if finer:
        items, orders = dealt(items, "order_id"), dealt(orders, "order_id")
    return items.join(orders, "order_id").select("order_id", "line", "security", "person", "second", "side", "quantity", "value", "tax", "discount", "day_from", "day_to", "status")


def deals(spark: SparkSession, folder: str) -> DataFrame:
    """Deals: events by client; the first and the last event type are sells."""
    events = table(spark, folder, "events")
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    return events.select(
        "event_id", F.col("user_id").alias("client"), F.col("ts").cast("date").alias("day"), "ts", "event_type",
        F.when(F.col("event_type").isin(ends["lo"], ends["hi"]), "SELL").otherwise("BUY").alias("side"), F.col("value").alias("quantity"),
        F.get_json_object("props", "$.k").cast("bigint").alias("security"),
    )


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of a part: its shipments' volume-weighted price and range."""
    from tidewater.operators.prices import daily_bars

    items = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("security"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"))
    # hardly two prints share a day here: they are dealt out before they are summed, and not after
    return daily_bars(dealt(items, "security", "day"), "security", "day", "v", "q")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The numbered days on which anything ships."""
    from tidewater.operators.prices import numbered_sessions

    return numbered_sessions(table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")), "day")


def ref():
    """The reference day of the windows."""
    return F.lit(REF).cast("date")
