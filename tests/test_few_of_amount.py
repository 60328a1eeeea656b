"""Rows that stand for all equal ones in a search for the only candidate."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import linkage


def few(spark, rows, prefix):
    df = spark.createDataFrame(rows, f"{prefix}id long, {prefix}k string, {prefix}c long, {prefix}q double")
    return df, linkage.few_of_amount(df, [f"{prefix}k"], f"{prefix}q", f"{prefix}c", f"{prefix}id")


def test_equal_deals_of_many_clients_are_few(spark):
    rows = [(i, "a", i % 40, 5.0) for i in range(4_000)] + [(9_000, "a", None, 5.0), (9_001, None, 1, 5.0), (9_002, "b", 1, 5.0)]
    got = sorted(r.lid for r in few(spark, rows, "l")[1].collect())
    assert got == [0, 1, 2, 40, 41, 42, 9_002]


@pytest.mark.parametrize("seed", [1, 2])
def test_only_candidates_are_the_same_as_among_all(spark, seed):
    deal = random.Random(seed)
    made = lambda n: [(i, deal.choice("abcdefghijkl"), deal.randrange(3), float(deal.choice([10, 10, 11, 14, 20, 31, 40]))) for i in range(n)]
    (left, some_left), (right, some_right) = few(spark, made(60), "l"), few(spark, made(60), "r")
    on = (F.col("lk") == F.col("rk")) & (F.col("lc") != F.col("rc")) & (F.abs(F.col("lq") - F.col("rq")) <= 0.2 * F.col("lq"))
    want, got = (sorted(map(tuple, linkage.unique_match(a, b, on, "lid", "rid").collect())) for a, b in ((left, right), (some_left, some_right)))
    assert got == want and want
