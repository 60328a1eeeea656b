"""Connected components of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import settled


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, and the node itself, hang on the smallest of its neighbourhood."""
    near = _both_ways(edges)
    lowest = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    # edges that come twice go in the small star
    return near.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(lowest, "a")
    return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of undirected ``edges`` (a, b): the smallest node that links reach.

    Large and small stars in turn, until no edge changes: the rounds grow with the logarithm of a chain's
    length. A node with very many neighbours is a key of partial aggregates and of joins that are split
    at run time, and is never gathered. Each round is settled. Loops and null ends give nothing.
    """
    now = settled(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        now = settled(_small_star(_large_star(now)), "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    # the edges are stars now: a node hangs on one root, and a root on none
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """A count and an order-free sum of hashes: what tells two sets of edges apart."""
    found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return found["n"], found["h"]
