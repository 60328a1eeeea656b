"""Parts of exact set-similarity joins: sets, regions, shared columns, rare-first prefixes, overlap counts and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.ragged import row_starts, slices
from tidewater.llm.shared import freed, written
from tidewater.llm.shingles import joined, line_cuts, shingle_sets

#: What tells distinct sets apart: the place of their first row, and two signatures.
PLACE, SIGNS = ["doc", "line"], ["n", "s1", "s2"]


def gram_sets(docs: DataFrame, width: int, percent: int, grams: str, lines: bool = False) -> DataFrame:
    """(doc, text) -> (doc, line, n, s1, s2, grams): each text's (or line's) set as its size, two independent 64-bit signatures, and n-grams in hash order.

    ``grams``: of ``whole`` sets, of their ``region`` (the lowest 1.5 * slack hashes, where slack is
    n - need + 1 and ``need`` the smallest overlap that a link of this set can have), or ``none``. Whole
    texts are line 0; lines without words give no row. A column ``wanted`` names the lines to give; without
    grams a column ``h`` of the text goes with its lines.
    """
    some, tagged = "wanted" in docs.columns, "h" in docs.columns and grams == "none"

    def listed(ids: pa.Array, texts: list[str], wanted: list | None, tags: pa.Array | None) -> pa.RecordBatch:
        data, cuts = joined(texts)
        owner, number = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        first = owner
        if lines:
            cuts, owner, number = line_cuts(data, cuts)
            first = np.flatnonzero(number == 0)
        n, found = shingle_sets(data, cuts, width)
        given = n > 0 if lines else np.ones(len(n), bool)
        if wanted is not None:
            asked = np.zeros(len(n), bool)
            asked[np.repeat(first, [len(w) for w in wanted]) + np.array([x for w in wanted for x in w], np.int64)] = True
            given &= asked
        starts, full = row_starts(n), n > 0
        s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        if full.any():
            s1[full] = np.add.reduceat(found, starts[:-1][full])
            s2[full] = np.bitwise_xor.reduceat(found * np.uint64(0x9E3779B97F4A7C15) ^ (found >> np.uint64(29)), starts[:-1][full])
        out = [ids.take(pa.array(owner[given])), pa.array(number[given].astype(np.int32)), pa.array(n[given]), pa.array(s1[given].view(np.int64)), pa.array(s2[given].view(np.int64))]
        if grams != "none":
            slack = n + (-percent * n // 100) + 1
            size = np.where(given, n if grams == "whole" else np.minimum(n, (3 * slack + 1) // 2), 0)
            place = np.arange(len(found)) - np.repeat(starts[:-1], n)
            found = found[place < np.repeat(size, n)]
            out.append(pa.ListArray.from_arrays(pa.array(row_starts(size[given]), pa.int32()), pa.array(found.view(np.int64))))
        if tags is not None:
            out.append(tags.take(pa.array(owner[given])))
        return pa.RecordBatch.from_arrays(out, names=["doc", "line", "n", "s1", "s2", "h" if tagged else "grams"][: len(out)])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            asked = batch.column(2).to_pylist() if some else None
            for texts in slices(batch.column(1).to_pylist(), 300_000):
                yield listed(batch.column(0).slice(at, len(texts)), texts, asked and asked[at : at + len(texts)], batch.column(batch.num_columns - 1).slice(at, len(texts)) if tagged else None)
                at += len(texts)
            pa.default_memory_pool().release_unused()

    read = docs.select("doc", "text", *(["wanted"] if some else []), *(["h"] if tagged else []))
    return read.mapInArrow(sets, "doc long, line int, n long, s1 long, s2 long" + (", grams array<long>" if grams != "none" else ", h long" if tagged else ""))


def distinct_sets(docs: DataFrame, width: int, percent: int, lines: bool = False) -> DataFrame:
    """(n, s1, s2, doc, line, grams): each distinct set that is not empty, at the first place that has it, with the n-grams of its region; written."""
    found = gram_sets(docs.where("doc is not null"), width, percent, "region", lines).where("n > 0")
    first = F.struct(*PLACE)
    reps = found.groupBy(*SIGNS).agg(F.min(first).alias("at"), F.min_by("grams", first).alias("grams"))
    return written(reps.select(*SIGNS, "at.*", "grams"), "set-regions")


def _counted(keys: np.ndarray) -> pa.RecordBatch:
    """(key, c): how often each name stands in ``keys``."""
    found, c = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(c)], names=["key", "c"])


def _by_column(g: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells sorted by n-gram (as an unsigned number), and which of them share it with another cell."""
    order = np.argsort(g.view(np.uint64))
    g, keys = g[order], keys[order]
    same = g[1:] == g[:-1]
    return g, keys, (np.append(same, False) | np.append(False, same))[: len(g)]


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def _dealt_cells(buckets: int, most: int):
    """Regions (grams, key) -> (bucket, g, keys, hot, known): cells by range of n-grams, very many to a row, so that Spark moves few rows.

    Of a column that stands twice among the ``most`` cells gathered at a time, the cells are known to be
    shared: only their names go on (``known``, in any bucket), and the n-gram itself once (``hot``).
    """

    def gathered(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        g, keys, twice = _by_column(*(np.concatenate(x) for x in zip(*held, strict=True)))
        hot, known = np.unique(g[twice].view(np.uint64)).view(np.int64), keys[twice]
        g, keys = g[~twice], keys[~twice]
        ends = (np.arange(1, buckets, dtype=object) * 2**64 // buckets).astype(np.uint64)
        cuts, hot_cuts = (np.concatenate([[0], np.searchsorted(x.view(np.uint64), ends), [len(x)]]) for x in (g, hot))
        known_cuts = np.arange(buckets + 1) * len(known) // buckets
        rows = np.arange(buckets, dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(rows), _lists(g, cuts), _lists(keys, cuts), _lists(hot, hot_cuts), _lists(known, known_cuts)], names=["bucket", "g", "keys", "hot", "known"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            g = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            held.append((g, np.repeat(batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))))
            size += len(g)
            if size >= most:
                yield gathered(held)
                held, size = [], 0
        if size:
            yield gathered(held)

    return cells


def _shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_dealt_cells`, a bucket's one after the other -> (key, c): in how many columns of a bucket a set meets another."""

    def settled(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        g, keys, hot, known = (np.concatenate(x) for x in zip(*held, strict=True))
        g, keys, twice = _by_column(g, keys)
        return _counted(np.append(keys[twice | np.isin(g, hot)], known))

    held, now = [], None
    for batch in batches:
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
        for start, end in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            if held and rows[start] != now:
                yield settled(held)
                held = []
            now = rows[start]
            held.append([batch.column(i).slice(start, end - start).flatten().to_numpy(zero_copy_only=False) for i in range(1, 5)])
    if held:
        yield settled(held)


def _shared_least(n: Column, percent: int) -> Column:
    """The fewest region columns that a set of size n shares with a linked one.

    Of m columns m - need may miss in a linked set, so of the region of the one whose region ends first all
    but these are shared. That rises with m, which is at least the smallest partner's size.
    """
    m = F.ceil(n * F.lit(percent) / 100)
    slack = m - F.ceil(m * F.lit(percent) / 100) + 1
    return F.least(m, F.floor((3 * slack + 1) / 2)) - slack + 1


def may_have_links(reps: DataFrame, percent: int, most: int = 1 << 20) -> DataFrame:
    """(doc, line, n, s1, s2) of the sets that can be in a link, by the shared columns of their regions; written.

    Incidence cells are dealt out by ranges of n-grams, ``most`` gathered at a time; there the columns that
    several sets have are found, and by set their number is added up. A hot column gives a bucket no more
    than one cell for each gathering. Of two linked sets the one whose region ends first shares at least
    region - (slack - 1) of its columns, and the other's size is within the similarity: sets with fewer
    shared columns than their smallest partner would need are in no link and leave. For this a set is
    named by 48 bits of its signature and by its size up to 65535: sets of one name, which are rare, only
    stay too long.
    """
    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.shiftleft(F.least("n", F.lit((1 << 16) - 1)), 48).bitwiseOR(F.col("s1").bitwiseAND(F.lit((1 << 48) - 1))).alias("key")
    buckets = 4 * parts
    cells = reps.select("grams", key).mapInArrow(_dealt_cells(buckets, most), "bucket int, g array<long>, keys array<long>, hot array<long>, known array<long>")
    met = cells.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_cells, "key long, c long")
    least = _shared_least(F.shiftrightunsigned("key", 48), percent)
    may = met.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("key")
    places = written(reps.select(*PLACE, *SIGNS, key).join(may, "key", "left_semi").select(*PLACE, *SIGNS), "set-candidates")
    freed(spark)
    return places


def numbered_sets(docs: DataFrame, places: DataFrame, width: int, percent: int, lines: bool = False) -> DataFrame:
    """(id, doc, line, n, s1, s2, grams): the whole sets ``places`` (doc, line, n, s1, s2); written. Ids rise with doc and line; several texts at one place are several sets.

    The places are range-sorted, and numbered by range and by row within it, before texts are read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*PLACE, *SIGNS]
    placed = places.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbers = written(placed.select(F.monotonically_increasing_id().alias("id"), *order), "set-numbers")
    wanted = places.groupBy("doc").agg(F.collect_set("line").alias("wanted"))
    # merges at any size: which documents are wanted grows with the input, and must not be broadcast
    asked = docs.join(wanted.hint("merge"), "doc").select("doc", "text", "wanted")
    found = gram_sets(asked, width, percent, "whole", lines).where("n > 0")
    sets = written(found.join(numbers.hint("merge"), order).dropDuplicates(order).select("id", *order, "grams"), "sets")
    freed(spark)
    return sets


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Prefixes (g, id, n, p, alone) of the sets that may link; written.

    Columns are ordered by their count of sets, then by hash, and the first slack columns of a set, of
    which p is the place, must meet those of each set that it links with. Columns of one set only,
    ``alone`` of each set, meet nothing.
    """
    grams = sets.select(F.explode("grams").alias("g"), "id", "n")
    counts = grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    slack = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    common = grams.join(counts, "g").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("common"))
    prefix = (
        common.withColumn("alone", F.col("n") - F.size("common"))
        .where(slack > F.col("alone"))
        .select("id", "n", "alone", F.posexplode(F.slice("common", F.lit(1), (slack - F.col("alone")).cast("int"))).alias("at", "cell"))
        .select(F.col("cell.g").alias("g"), "id", "n", (F.col("alone") + F.col("at")).alias("p"), "alone")
    )
    return written(prefix, "set-prefixes")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    overlap = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(left, "a").join(right, "b").where(100 * overlap >= percent * (F.col("na") + F.col("nb") - overlap)).select("a", "b")


def may_link(percent: int) -> Column:
    """Sizes and places of a common column (the first that two sets share) from which an overlap can still be large enough."""
    return _enough(F.lit(1), percent) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))


def _enough(overlap: Column, percent: int) -> Column:
    """Whether an overlap up to places pa and pb, and all that may follow them, can make a link."""
    best = overlap + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    return (100 + percent) * best >= percent * (F.col("na") + F.col("nb"))


def overlap_counts(one: DataFrame, two: DataFrame, pick: Column, percent: int) -> DataFrame:
    """The product of incidence rows (g, a, na, pa, ...) and (g, b, nb, pb, ...), as the pairs that may still be links.

    A partition of the join is a block of columns: its partial sums by pair are that block's product, and
    the sums by pair over blocks are the overlaps within both prefixes. Cells whose places and sizes bound
    the overlap below a link's are left out before they are added; pairs are left out when the overlap
    counted and the columns behind the last common one are too few.
    """
    cells = one.join(two, "g").where(pick & may_link(percent))
    counted = cells.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("overlap"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    return counted.where(_enough(F.col("overlap"), percent)).select("a", "b")


def open_rows(prefixes: DataFrame, placed: DataFrame) -> DataFrame:
    """Prefix rows with ``of``, the component of their set in ``placed`` (node, component), of columns that meet more than one component."""
    rows = prefixes.join(placed, F.col("id") == F.col("node"), "left").select("g", "id", "n", "p", "alone", F.coalesce("component", "id").alias("of"))
    mixed = rows.groupBy("g").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("g")
    return rows.join(mixed, "g", "left_semi")


def central_tries(rows: DataFrame, turn: int) -> DataFrame:
    """Each set of ``rows`` with the leader of another component that it meets in most columns: pairs (a, b), a < b, at most one for a set.

    A column's leader is at turn 0 the set with the smallest share of n-grams of its own, which in a
    group of edited copies is the one nearest to their source; later it is another one at each turn.
    """
    rank = F.struct(F.col("alone") / F.col("n"), "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)), "id")
    leaders = rows.groupBy("g").agg(F.min_by(F.struct(F.col("id").alias("leader"), F.col("of").alias("led")), rank).alias("by")).select("g", "by.*")
    tries = rows.join(leaders, "g").where("of <> led").groupBy("id", "leader").agg(F.count("*").alias("c"))
    best = tries.groupBy("id").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
    return best.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def earlier_tries(prefixes: DataFrame, settled: DataFrame | None) -> DataFrame:
    """Each set that is not in ``settled`` (id) with the earliest set not in it of a column, the one that it meets in most columns: pairs (a, b), a < b, one row for a b."""
    rows = prefixes if settled is None else prefixes.join(settled, "id", "left_anti")
    leaders = rows.groupBy("g").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1")
    tries = rows.join(leaders, "g").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("c"))
    return tries.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")


def as_smaller(percent: int) -> Column:
    """Places of a column (n, p) at which a set can still overlap enough with one that is no smaller."""
    return (100 + percent) * (F.col("n") - F.col("p")) >= 2 * percent * F.col("n")


def pairs_ahead(rows: DataFrame, percent: int) -> tuple[int, int]:
    """How many rows there are, and about how many pairs of them, counted by column, a join between components would make."""
    near = rows.groupBy("g", "of").agg(F.count("*").alias("rows"), F.sum(as_smaller(percent).cast("double")).alias("k"))
    columns = near.groupBy("g").agg(F.sum("rows").alias("rows"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"))
    found = columns.agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
    return int(found["rows"] or 0), int(found["pairs"] or 0)
