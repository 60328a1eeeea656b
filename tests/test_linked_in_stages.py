"""Links by columns, stage by stage: unique or not made, in one shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_records import brute_stages

from tidewater.operators import linkage

STAGES = [["a", "b", "c"], ["a", "b"], ["a", "c"]]


@pytest.mark.parametrize(("seed", "of"), [(1, 5), (2, 9), (3, 30)])
def test_columns_link_as_identifiers_do(spark, seed, of):
    """The same links as of all pairs and as :func:`staged_links`; nulls in a column of the stage link nothing, rows of no side or without an id neither."""
    deal = random.Random(seed)
    rows = [(i, deal.random() < 0.5, *(deal.choice([None, *map(str, range(n))]) for n in (of, of, of // 2))) for i in range(150)]
    told = lambda r, stage: None if None in (parts := [r[2 + "abc".index(c)] for c in stage]) else "|".join(parts)
    sides = [[(r[0], [[told(r, stage)] for stage in STAGES]) for r in rows if r[1] is on] for on in (True, False)]
    want = brute_stages(*sides, len(STAGES))
    odd = [(900, None, "0", "0", "0"), (None, True, "0", "0", "0"), (None, False, "1", "1", "1")]
    df = spark.createDataFrame(rows + odd, "id long, mine boolean, a string, b string, c string")
    got = linkage.linked_in_stages(df, F.col("mine"), "id", "l", "r", STAGES).collect()
    assert {r.l: (r.r, r.stage) for r in got} == want and len(got) == len(want) and len({s for _, s in want.values()}) > 1
    old = [spark.createDataFrame([(i, *k) for i, k in side], "id long, x array<string>, y array<string>, z array<string>") for side in sides]
    staged = linkage.staged_links(old[0].withColumnRenamed("id", "l"), old[1].withColumnRenamed("id", "r"), "l", "r", ["x", "y", "z"]).collect()
    assert sorted(map(tuple, got)) == sorted((r.l, r.r, r.stage) for r in staged)


def test_rows_are_dealt_out_once(spark):
    """All stages read one shuffle; nothing is joined or settled on the way."""
    df = spark.range(50).select("id", (F.col("id") % 2 == 0).alias("mine"), *((F.col("id") / n).cast("int").alias(c) for c, n in (("a", 9), ("b", 4), ("c", 2))))
    got = linkage.linked_in_stages(df, F.col("mine"), "id", "l", "r", STAGES)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "parquet" not in plan.lower()


def test_stages_share_a_column(spark):
    with pytest.raises(ValueError, match="part of every stage"):
        linkage.linked_in_stages(spark.range(1), F.lit(True), "id", "l", "r", [["a"], ["b"]])
