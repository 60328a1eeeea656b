"""Audit of how word distributions of sources diverge, over run-length encoded columns of counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import bounded_batches, text_or_empty, written

#: Shares are counted in parts of this.
SCALE = 1_000_000_000

#: Bytes of terms: ASCII letters, the capitals lower-cased, and all bytes of other characters; the rest are spaces.
_FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

#: Distinct terms that a task holds before it passes their counts on.
HELD = 200_000

#: Cells of a block of count columns.
CELLS = 1 << 21


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> (lang, source, term, n, docs): occurrences and documents that tasks counted, and rows with null term for each group.

    Tasks count in bounded tables and pass them on. Texts are taken as UTF-8 bytes: separators are ASCII,
    so terms are whole characters.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        sizes: Counter = Counter()
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                for at in range(0, len(terms), 50_000):
                    part = terms.slice(at, 50_000)
                    counts = (pa.array(list(islice(c.values(), at, at + 50_000))) for c in (n, docs))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), part, *counts], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for k, (lang, source) in enumerate(zip(langs, sources, strict=True)):
                sizes[lang, source] += 1
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                terms = texts[k].as_py().translate(_FOLD).split()
                before = len(n)
                n.update(terms)
                docs.update(dict.fromkeys(terms).keys())  # new terms enter both in one order
                held += len(n) - before
                if held > HELD:
                    yield from flushed()
                    held = 0
        yield from flushed()
        if sizes:
            keys = list(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.nulls(len(keys), pa.string()), pa.array([0] * len(keys)), pa.array([sizes[k] for k in keys])], names=["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def scaled_share(count: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)`` exactly, by long division in three digits of base 1,000."""
    rest, out = count.astype(np.int64) + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def runs(column: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column of counts, each standing for ``lengths`` equal terms, as (first row, count) of its runs."""
    starts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    return starts, column[starts]


def _pair_sums(columns: np.ndarray, lengths: np.ndarray, totals: list[int], out: np.ndarray) -> None:
    """Adds each ordered pair's sum of floor((p - q)^2 / q) over a block of columns to ``out``: runs are intersected, and f counts as often as a run is long."""
    place = np.append(0, np.cumsum(lengths))
    encoded = []
    for column, total in zip(columns, totals, strict=True):
        starts, counts = runs(column, lengths)
        encoded.append((starts, scaled_share(counts, total)))
    for a in range(len(encoded)):
        for b in range(a):
            cuts = np.union1d(encoded[a][0], encoded[b][0])
            width = place[np.append(cuts[1:], len(lengths))] - place[cuts]
            p, q = (s[np.searchsorted(starts, cuts, "right") - 1] for starts, s in (encoded[a], encoded[b]))
            square = (p - q) ** 2
            out[a, b] += int((square // q * width).sum())
            out[b, a] += int((square // p * width).sum())


def _stretches(langs: pa.Array) -> Iterator[tuple[str, range]]:
    """Rows of a sorted column by value."""
    encoded = langs.dictionary_encode()
    codes = encoded.indices.to_numpy()
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
    for start, stop in zip(starts, np.append(starts[1:], len(codes)), strict=True):
        yield encoded.dictionary[codes[start]].as_py(), range(int(start), int(stop))


def _dense(cells: pa.Array, sources: list[str]) -> np.ndarray:
    """sources x rows: the counts of a column of (source, n) lists."""
    flat = cells.flatten()
    out = np.zeros((len(sources), len(cells)), np.int64)
    lengths = np.diff(cells.offsets.to_numpy())
    places = pc.index_in(flat.field(0), pa.array(sources, pa.string())).to_numpy(zero_copy_only=False)
    out[places, np.repeat(np.arange(len(cells)), lengths)] = flat.field(1).to_numpy(zero_copy_only=False)
    return out


def pair_divergences(kept: DataFrame, groups: list) -> DataFrame:
    """(lang, source, item, value) of the pairs of a language's sources, from (lang, cells) of each kept term, cells being its (source, n) in order of source.

    The vocabulary is reordered: terms with the same counts in every source become one row with a length,
    and these are range-sorted by their counts, so that equal counts of a source stand together. A task
    has a stretch of that order; it encodes the column of each source by runs, in blocks of bounded size,
    and adds up pairs. Tasks send one row a pair and language.

    ``groups`` has (lang, source, n, terms) of every group. Each block needs those of all sources of its
    language, so they are sent to all tasks: as the result has the square of a language's sources, they
    are no more than the square root of the result's rows a language.
    """
    order: dict[str, list[str]] = {}
    totals: dict[str, list[int]] = {}
    for g in sorted(groups, key=lambda g: (g.lang, g.source)):
        order.setdefault(g.lang, []).append(g.source)
        totals.setdefault(g.lang, []).append(g.n + g.terms)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in _stretches(batch.column(0)):
                step = max(16, CELLS // len(order[lang]))
                for at in range(rows.start, rows.stop, step):
                    part = batch.slice(at, min(step, rows.stop - at))
                    out = sums.setdefault(lang, np.zeros((len(order[lang]),) * 2, np.int64))
                    _pair_sums(_dense(part.column(1), order[lang]), part.column(2).to_numpy(zero_copy_only=False), totals[lang], out)
        for name, out in sums.items():
            for a, source in enumerate(order[name]):
                others = [b for b in range(len(out)) if b != a]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(others)), pa.array([source] * len(others)), pa.array([order[name][b] for b in others], pa.string()), pa.array(out[a, others])], names=["lang", "source", "item", "value"])

    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = kept.groupBy("lang", "cells").agg(F.count("*").alias("length")).repartitionByRange(parts, "lang", "cells").sortWithinPartitions("lang", "cells")
    return columns.mapInArrow(summed, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: Column, total: Column) -> Column:
    """:func:`scaled_share` in decimals."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE), total.cast("decimal(20,0)")) + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and by which terms.

    A language keeps the terms of at least ``least_docs`` of its documents. In each (lang, source) group,
    and in each language, a kept term has p = 1 + floor(10^9 (count + 1) / (N + V)), N being the group's
    occurrences of the V kept terms. Part ``pair`` gives the sum of floor((p - q)^2 / q) over all kept
    terms for each other source (its q); part ``term`` the ``top`` terms that the group has, and more
    often than its language (q), by the same figure. All arithmetic is exact.

    Counts of all groups come from one pass and one exchange. A term's list has one entry a source. Pairs are summed over run-length columns (see
    :func:`pair_divergences`). Terms are ranked in 64 buckets a group first, so that a large group's list
    is spread over tasks.

    Null text, language and source are empty ones; each row counts as a document, repeated ids too.
    Ties rank by term or source in UTF-8 order. A group without kept terms has its pairs (0 where the
    language keeps no term) and no terms. An empty table gives no rows; other columns are not read.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(*(text_or_empty(c).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    # tasks have counted: one exchange by language and term serves the sums by source and those by term
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    found = written(by_term.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "term", "whole", "cells"), "audit-terms")
    kept = found.where("term is not null")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("all"))
    sums = kept.select("lang", F.explode("cells").alias("cell")).groupBy("lang", "cell.source").agg(F.sum("cell.n").alias("n"))
    named = found.where("term is null").select("lang", F.explode("cells.source").alias("source")).join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(named.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "terms", "all"))), "audit-groups")

    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    values = pair_divergences(kept.select("lang", "cells"), groups.collect())
    by_value = [F.desc("value"), "item"]
    ranked = pairs.join(values, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    pair_rows = ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)).alias("rank"))

    cells = kept.select("lang", "whole", F.col("term").alias("item"), F.explode("cells").alias("cell")).select("lang", "cell.source", "item", "cell.n", "whole")
    shares = cells.join(groups.withColumnsRenamed({"n": "total"}), ["lang", "source"]).where("n > 0").select(
        "lang", "source", "item", _share(F.col("n"), F.col("total") + F.col("terms")).alias("p"), _share(F.col("whole"), F.col("all") + F.col("terms")).alias("q")
    )
    above = shares.where("p > q").select("lang", "source", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"), (F.xxhash64("item") % 64).alias("bucket"))
    first = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "bucket").orderBy(*by_value))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).where(F.col("rank") <= top)
    return pair_rows.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
