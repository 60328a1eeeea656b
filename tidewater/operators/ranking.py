"""Places and neighbours in a total order, without gathering a key or the whole table in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import FINER, settled

#: Names that the helpers of this module add, and drop again.
STRETCH, AT = "_stretch", "_at"


def sorted_stretches(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` range-sorted by ``order`` with ``_stretch``, the number of its range, and ``_at``, its row in the range from 0; settled.

    A range sort deals rows out evenly whatever their keys are, so a stretch is bounded by the table's
    size over the number of partitions. Rows that are equal in ``order`` share a stretch.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stretch, row = F.spark_partition_id(), F.monotonically_increasing_id()
    return settled(placed.withColumns({STRETCH: stretch, AT: row - F.shiftleft(stretch.cast("long"), 33)}), "stretches")


def counted_on(placed: DataFrame, output: str) -> DataFrame:
    """The table of :func:`sorted_stretches` with each row's number from 0. Stretches' sizes, one row each, give the offsets."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(F.col(STRETCH).alias("s")).agg(F.count("*").alias("n")).select("s", before.alias("start"))
    return placed.join(F.broadcast(starts), F.col(STRETCH) == F.col("s")).withColumn(output, F.col("start") + F.col(AT)).drop("s", "start")


def numbered(df: DataFrame, order: list[str | Column], output: str = "place") -> DataFrame:
    """``df`` with the row number of ``order`` over the whole table, from 0."""
    return counted_on(sorted_stretches(df, order), output).drop(STRETCH, AT)


def numbered_within(df: DataFrame, keys: list[str], order: list[str | Column], output: str = "place") -> DataFrame:
    """``df`` with the row number of ``order`` within each key, from 1; null keys are one key. A key with very many rows stays spread over stretches."""
    placed = sorted_stretches(df, [*keys, *order])
    named = [F.col(k).alias(f"_{k}") for k in keys]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*(f"_{k}" for k in keys)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(*named, F.col(STRETCH).alias("s")).agg(F.count("*").alias("n"), F.min(AT).alias("first")).withColumn("start", before)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(STRETCH) == F.col("s")]
    return placed.join(starts, same).withColumn(output, F.col("start") + F.col(AT) - F.col("first") + 1).drop("s", "n", "first", "start", STRETCH, AT, *(f"_{k}" for k in keys))


def with_previous(df: DataFrame, order: list[str | Column], carried: list[str], output: str = "previous") -> DataFrame:
    """``df`` with struct ``output``: the columns ``carried`` of the row before in ``order``; null for the first row.

    Each stretch looks within itself; the last row of a stretch, one row each, is what the next one that
    has rows starts from.
    """
    placed = sorted_stretches(df, order)
    row = F.struct(*carried)
    lasts = placed.groupBy(F.col(STRETCH).alias("s")).agg(F.max_by(row, AT).alias("last"))
    ahead = lasts.select("s", F.lag("last").over(Window.orderBy("s")).alias("ahead"))
    inside = F.lag(row).over(Window.partitionBy(STRETCH).orderBy(AT))
    found = placed.withColumn("inside", inside).join(F.broadcast(ahead), F.col(STRETCH) == F.col("s"))
    return found.withColumn(output, F.when(F.col(AT) == 0, F.col("ahead")).otherwise(F.col("inside"))).drop("s", "ahead", "inside", STRETCH, AT)


def _repeats(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first equals the one before it; nulls are equal."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    return pc.if_else(pc.and_(pc.is_null(now), pc.is_null(before)), True, pc.fill_null(pc.equal(now, before), False)).to_numpy()


def _read_runs(gap: int):
    """Reads a sorted stretch (keys, at, item) in batches: links (a, b) of items to the first one of their run (which = 0), the stretch's first row (1) and its last (2)."""

    def table(a, b, which: int, rest: pa.Table | None, like: pa.Schema) -> pa.RecordBatch:
        n = len(a)
        ends = [c.combine_chunks() for c in rest.columns[:-1]] if rest is not None else [pa.nulls(n, f.type) for f in list(like)[:-1]]
        columns = [pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(np.full(n, which, np.int32)), a, b, *ends]
        return pa.RecordBatch.from_arrays(columns, names=["part", "which", "a", "b", *like.names[:-1]])

    def end(row: pa.Table, which: int) -> pa.RecordBatch:
        return table(row["item"].combine_chunks(), pa.nulls(1, row["item"].type), which, row, row.schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = start = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            if last is None:
                last, start = rows.slice(0, 1), rows["item"].slice(0, 1)
                yield end(last, 1)
                rows = rows.slice(1)
            if rows.num_rows:
                seen = pa.concat_tables([last, rows])
                follows = np.logical_and.reduce([_repeats(c) for c in seen.columns[:-2]] + [np.diff(seen["at"].to_numpy()) <= gap])
                first = np.maximum.accumulate(np.where(follows, 0, np.arange(1, len(follows) + 1)))
                starts = pa.chunked_array([*start.chunks, *rows["item"].chunks]).take(pa.array(first))
                a, b = (c.filter(pa.array(follows)).combine_chunks() for c in (rows["item"], starts))
                yield table(a, b, 0, None, rows.schema)
                last, start = rows.slice(rows.num_rows - 1), starts.slice(rows.num_rows - 1)
        if last is not None:
            yield end(last, 2)

    return read


def run_links(rows: DataFrame, same: list[str], at: str, item: str, gap: int) -> DataFrame:
    """(a, b): in rows sorted by ``same``, ``at`` (long) and ``item``, each item of a run and the first one of it.

    A run is rows that are equal in ``same`` (null keys are equal) with no more than ``gap`` from one to the
    next. Runs are read along range-sorted stretches, and only their links are written; one that goes on in
    the next stretch is linked there to that stretch's first row, and this to the last row before it. So a
    run of any length is never gathered.
    """
    parts = FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"k{i}" for i in range(len(same))]
    named = rows.select(*(F.col(c).alias(k) for c, k in zip(same, keys, strict=True)), F.col(at).alias("at"), F.col(item).alias("item"))
    types = dict(named.dtypes)
    schema = ", ".join(["part int", "which int", f"a {types['item']}", f"b {types['item']}", *(f"{c} {types[c]}" for c in (*keys, "at"))])
    found = settled(named.repartitionByRange(parts, *named.columns).sortWithinPartitions(*named.columns).mapInArrow(_read_runs(gap), schema), "runs")
    ends = found.where("which > 0").withColumn("before", F.lag(F.struct("a", "at", *keys)).over(Window.orderBy("part", "which")))
    goes_on = F.struct(*keys).eqNullSafe(F.struct(*(F.col(f"before.{k}").alias(k) for k in keys))) & (F.col("at") - F.col("before.at") <= gap)
    return found.where("which = 0").select("a", "b").unionByName(ends.where((F.col("which") == 1) & goes_on).select("a", F.col("before.a").alias("b")))
