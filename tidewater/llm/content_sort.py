"""Exact deduplication by a distributed sort of the contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import outputs_over, text_or_empty, written

_RUNS = "id long, text_sha256 string, run_keep long, run_size long, edge boolean, partition int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by content -> each row with its run of equal neighbours in this partition.

    A run's ids are all that is held, never its texts. The first and the last run may go on in a
    neighbouring partition and are marked as edges; so is each run that shares their content hash.
    """
    import hashlib

    import numpy as np
    from pyspark import TaskContext

    partition = TaskContext.get().partitionId()
    ids, lengths, shas, hashes = [], [], [], []  # ids by batch; a run's length, digest and content hash
    last = None
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        if not len(texts):
            continue
        ids.append(batch.column(batch.schema.get_field_index("id")))
        same = np.zeros(len(texts), bool)
        same[0] = last is not None and texts[0].as_py() == last
        if len(texts) > 1:
            same[1:] = pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        ends = np.append(starts[1:], len(texts)) if len(starts) else starts
        if lengths:
            lengths[-1] += int(starts[0]) if len(starts) else len(texts)
        heads = batch.column(batch.schema.get_field_index("hash")).to_numpy(zero_copy_only=False)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            lengths.append(b - a)
            shas.append(hashlib.sha256(texts[a].as_py().encode()).hexdigest())
            hashes.append(int(heads[a]))
        last = texts[len(texts) - 1].as_py()
    if not ids:
        return
    flat = pa.concat_arrays(ids)
    sizes = np.array(lengths)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # null ids count as below all others
    keep = np.maximum.reduceat(flat.fill_null(np.iinfo(np.int64).min).to_numpy(), begin)
    hashed = np.array(hashes)
    edge = (hashed == hashed[0]) | (hashed == hashed[-1])
    run = np.repeat(np.arange(len(sizes)), sizes)
    digests = pa.array(shas)
    for at in range(0, len(run), 20_000):
        r = run[at : at + 20_000]
        yield pa.RecordBatch.from_arrays(
            [flat[at : at + len(r)], digests.take(pa.array(r)), pa.array(keep[r]), pa.array(sizes[r]), pa.array(edge[r]), pa.array(np.full(len(r), partition, np.int32))],
            names=["id", "text_sha256", "run_keep", "run_size", "edge", "partition"],
        )


def content_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Method: ``repartitionByRange`` samples splitters over (first 32 characters, 64-bit content hash, id);
    each range is sorted externally by head, hash, whole text and id, which puts equals next to each
    other; full texts are then compared with their neighbours. The id among the splitters lets a group of
    any size run over several ranges; only splitters of bounded size reach the driver, never texts. Runs
    at a range's edges meet in a table of at most a few rows a range, summed by digest.

    ``keep``: the row with the ``largest`` or ``smallest`` id stays. Null text counts as empty. Of rows
    with the group's kept id the first stays alone (repeated ids in a group all say kept). A null id
    counts below all others. An empty table gives no rows.
    """
    sign = 1 if keep == "largest" else -1
    text = text_or_empty(text_col)
    keyed = df.select((F.col(id_col).cast("long") * sign).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.substring(text, 1, 32).alias("head"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = written(
        keyed.repartitionByRange(parts, "head", "hash", "id").sortWithinPartitions("head", "hash", "text", "id").select("id", "text", "hash").mapInArrow(_runs, _RUNS),
        "content-runs",
    )
    edges = (
        runs.where("edge")
        .groupBy("partition", "text_sha256")
        .agg(F.max("run_keep").alias("run_keep"), F.max("run_size").alias("run_size"))
        .groupBy("text_sha256")
        .agg(F.max("run_keep").alias("edge_keep"), F.sum("run_size").alias("edge_size"))
        .withColumnRenamed("text_sha256", "digest")
    )
    inner = runs.where("not edge").withColumns({"edge_keep": F.lit(None).cast("long"), "edge_size": F.lit(None).cast("long")})
    # the edge table holds at most two contents a range (and those of equal 64-bit hash): its size is bound by the number of ranges
    outer = runs.where("edge").join(F.broadcast(edges), F.col("text_sha256") == F.col("digest")).select(*inner.columns)
    best = F.coalesce("edge_keep", "run_keep")
    lowest = F.lit(-(2**63))
    return inner.unionByName(outer).select(
        (F.col("id") * sign).alias("doc_id"),
        F.when(best != lowest, best * sign).alias("keep_id"),
        F.coalesce("edge_size", "run_size").cast("long").alias("group_size"),
        (F.coalesce(F.col("id"), lowest) == best).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``df`` whose text is the kept one of its group; where ids repeat within a group, the row whose columns hash lowest."""
    groups = content_groups(df, id_col, text_col, keep).where("kept").select("doc_id", "text_sha256").dropDuplicates()
    tie = F.xxhash64(*(f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()))
    packed = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("digest"), tie.alias("tie"))
    joined = packed.join(groups, packed["id"].eqNullSafe(groups["doc_id"]) & (packed["digest"] == groups["text_sha256"]), "left_semi")
    return outputs_over("row", joined.groupBy("id", "digest").agg(F.min_by("row", "tie").alias("row")), [])
