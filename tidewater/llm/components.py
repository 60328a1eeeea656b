"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or else smaller) neighbours to the smallest node near it."""
    near = _both_ways(edges)
    if not large:
        near = near.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least.withColumnRenamed("u", "of"), F.col("u") == F.col("of"))
    moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Links (a, b) -> (node, component): the smallest node reachable; nodes without a link to another do not appear.

    Alternates large-star and small-star rounds, each a shuffle by node, until nothing changes: the
    number of rounds grows with the logarithm of the longest path, not with the number of links. Each
    round is written to the shared folder. A null end, a self-link or a repeated link changes nothing.
    """
    now = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = written(now, "links"), None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = tuple(state)
        now = written(_star(_star(now, large=True), large=False), "links")
