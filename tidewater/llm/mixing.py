"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import outputs_over, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(name: str):
    """The number of words of a text column as a long (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by water filling: (source, source_size) -> (source, source_size, target).

    Sources in code-point order (null last) take ``weights`` in turn. A target is the level times the
    weight, at most ``most`` times the source's size, with the one level at which the targets sum to
    ``share`` times all sizes. Resharing an excess by weight until none is above a limit ends at that
    level. The table has one row a source; the windows over all of it read only these.
    """
    first = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(first) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))
    return (
        ranked.withColumn("level", level)
        .withColumn("open_level", F.first(open_level, ignorenulls=True).over(whole))
        .select("source", "source_size", F.coalesce(F.least("stop", F.col("open_level") * F.col("weight")), F.col("stop")).alias("target"))
    )


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", tie_col: str | None = None) -> DataFrame:
    """Every row with ``source_size``, ``target`` and ``taken``, the words that the mix takes of it.

    Method: a row's key is the MD5 of its id and ``seed``, uniform and the same in each run. Within a
    source the rows are range-sorted by key: the first hex digits, three or as many more as keep a range
    under a million rows, cut the key space into even ranges, so a source with a third of all rows is
    spread over as many tasks. Sums by range,
    prefix sums over a source's ranges and prefix sums within each range give a row's place. A budget
    of e whole passes and a rest takes each row e times, and once more up to the rest; the row on the
    edge is taken in part, so a source gives exactly ``floor(target)`` words.

    Null sources form one source, the last. A null id sorts by an empty id, a null size counts 0. Rows of
    one id and size follow by ``tie_col``; without one they may change places, which gives the same rows
    where id, source and size are all there is. An empty table gives no rows. Columns of the output's names
    are replaced.
    """
    packed = df.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")).alias("key"),
        (F.col(tie_col) if tie_col else F.lit(None).cast("long")).alias("tie"),
    )
    digits = max(3, math.ceil(math.log(max(1, df.count()) / 1e6, 16)))
    packed = packed.withColumn("range", F.substring("key", 1, digits))
    ranges = written(packed.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("range").alias("in"), "start", "source_size", "target")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size", *(["tie"] if tie_col else [])).rowsBetween(Window.unboundedPreceding, -1)
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target") - passes * F.col("source_size")
    placed = (
        packed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
        .withColumn("taken", (passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("ahead")))).cast("long"))
    )
    return outputs_over("row", placed, ["source_size", "target", "taken"])


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of the mix themselves, with the columns of ``df``, whatever their names.

    A row taken for e whole passes stands e times; the row on a source's edge also stands once with its
    first words only, cut after the last word taken. Rows without words belong to no budget and stay once.
    Rows that repeat an id follow by a hash of all their columns, so that each run takes the same.
    """
    tie = F.xxhash64(*(f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()))
    packed = df.select(F.struct("*").alias("doc"), F.col(id_col).alias("of"), F.col(source_col).alias("from"), word_count(text_col).alias("words"), tie.alias("hash"))
    mixed = mix(packed, "of", "from", "words", tie_col="hash", **how)
    part = F.when(F.col("words") > 0, F.col("taken") % F.col("words")).otherwise(F.lit(0))
    whole = F.when(F.col("words") > 0, F.floor(F.col("taken") / F.col("words"))).otherwise(F.lit(1)).cast("int")
    text = F.col("doc")[text_col]
    pieces = F.split(F.coalesce(text.cast("string"), F.lit("")), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each word with the space before it
    head = F.array_join(F.slice(pieces, F.lit(1), part.cast("int")), "")
    copies = F.concat(F.array_repeat(text, whole), F.when(part > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    return mixed.select("doc", F.explode(copies).alias("copy")).select(*(F.col("copy").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in df.columns))
