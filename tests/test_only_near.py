"""Rows whose only candidate each is, among amounts near to each other, without pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import linkage

SCHEMA = "id long, k string, q double, c long"


def brute(left, right):
    """SQL's pairs: joined, then single by both ids. Numbers compare as Spark's: NaN is equal to itself and above all."""
    high = lambda x: (x != x, 0.0 if x != x else x)
    fits = lambda a, b: high(abs(a - b)) <= high(0.2 * a)
    pairs = [(a, b) for a, k, q, c in left for b, k2, q2, c2 in right if None not in (k, k2, q, q2, c, c2) and k == k2 and c != c2 and fits(q, q2)]
    one, two = [a for a, _ in pairs], [b for _, b in pairs]
    return sorted((p for p in pairs if one.count(p[0]) == 1 and two.count(p[1]) == 1), key=repr)


def found(spark, left, right):
    got = linkage.only_near(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], "q", "c", "id", "l", "r", 0.2)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize(("seed", "spread"), [(1, 40), (2, 400), (3, 4_000)])
def test_only_candidates_are_those_of_all_pairs(spark, seed, spread):
    """Also with ids that repeat, runs of one client, equal rows, endless amounts, nulls, and no or negative amounts."""
    deal = random.Random(seed)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -5.0]

    def made(n, first):
        q = lambda: deal.choice(odd) if deal.random() < 0.04 else deal.randrange(1, spread) * deal.choice([1.0, 1.0, 0.1])
        return [(first + (deal.randrange(n) if deal.random() < 0.05 else i), deal.choice(["a", "b", "c", "d", "e", "f", "g", "h", None]), q(), deal.choice([0, 0, 1, 2, None])) for i in range(n)]

    left, right = made(120, 0), made(120, 1_000)
    left, right = left + left[:3], right + right[:3]
    want = brute(left, right)
    assert found(spark, left, right) == want and want


def test_edges_of_the_tolerance_are_as_compared(spark):
    left = [(i, str(i), q, 1) for i, q in enumerate([10.0, 10.0, 0.3, 1e16, 5.0])]
    right = [(100 + i, str(i), q, 2) for i, q in enumerate([8.0, 12.000000000000002, 0.36, 1.2e16, 4.0])]
    assert found(spark, left, right) == brute(left, right)


def test_distinct_amounts_of_a_day_make_no_pairs(spark):
    """The plan joins nothing but the few endless amounts: a day of many amounts is sorted, not multiplied."""
    rows = spark.range(2_000).select(F.col("id"), F.lit("a").alias("k"), (100 + F.col("id") / 1000).alias("q"), F.col("id").alias("c"))
    got = linkage.only_near(rows, rows.withColumn("c", -F.col("c") - 1), ["k"], "q", "c", "id", "l", "r", 0.2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and got.count() == 0
