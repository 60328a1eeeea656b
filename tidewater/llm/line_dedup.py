"""Removal of near-equal lines by an exact set-similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.set_join import PLACE, SIGNS, distinct_sets, earlier_tries, gram_sets, may_have_links, numbered_sets, overlap_counts, rare_prefixes, verified
from tidewater.llm.shared import bounded_batches, freed, outputs_over, text_or_empty, written


def _ahead(prefixes: DataFrame, settled: DataFrame) -> tuple[int, int]:
    """Rows of columns with a set that is not settled, and about how many pairs a join of such sets with all would make."""
    rows = prefixes.join(settled.withColumn("known", F.lit(1)), "id", "left")
    columns = rows.groupBy("g").agg(F.count("*").alias("all"), F.count_if(F.col("known").isNull()).cast("double").alias("open")).where("open > 0")
    found = columns.agg(F.sum("all").alias("rows"), F.sum(F.col("open") * (F.col("all") - 1)).alias("pairs")).first()
    return int(found["rows"] or 0), int(found["pairs"] or 0)


def _matched(prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id) of the sets with an earlier match.

    Each set is tried against the earliest one of the column that it meets in most columns, and those that
    are left against the earliest one left, while the pairs ahead outnumber the incidence rows and fall by
    a tenth at least. Then the sets that are left are joined with all earlier ones.
    """
    matched = written(verified(earlier_tries(prefixes, None), sets, percent).select(F.col("b").alias("id")), "line-stars")
    tried = None
    rows, ahead = _ahead(prefixes, matched)
    while ahead > rows:
        before = ahead
        # leaders that were tried and are not matched themselves do not lead again
        fresh = prefixes.join(matched, "id", "left_anti").groupBy("g").agg(F.min("id").alias("id")).select("id").distinct()
        tried = written(fresh if tried is None else tried.unionByName(fresh).distinct(), "line-tried")
        found = verified(earlier_tries(prefixes, matched.unionByName(tried)), sets, percent).select(F.col("b").alias("id"))
        matched = written(matched.unionByName(found).distinct(), "line-stars")
        rows, ahead = _ahead(prefixes, matched)
        if 10 * ahead > 9 * before:
            break
    two = prefixes.join(matched, "id", "left_anti").select("g", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    one = prefixes.select("g", F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    pairs = overlap_counts(one, two, F.col("a") < F.col("b"), percent)
    return matched.unionByName(verified(pairs, sets, percent).select(F.col("b").alias("id"))).distinct()


def _firsts_and_matches(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc, text): each distinct set at its first place, and those of them that have an earlier match, as (doc, line, n, s1, s2); written."""
    spark = docs.sparkSession
    reps = distinct_sets(docs, width, percent, lines=True)
    freed(spark)
    places = may_have_links(reps, percent)
    sets = numbered_sets(docs, places, width, percent, lines=True)
    prefixes = rare_prefixes(sets, percent)
    freed(spark)
    matched = _matched(prefixes, sets, percent)
    gone = written(sets.join(matched, "id", "left_semi").select(*PLACE, *SIGNS), "line-matches")
    return reps.select(*PLACE, *SIGNS), gone


def _removed(docs: DataFrame, firsts: DataFrame, gone: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, h, line) of the lines of (doc, text, h) whose set is not first met there, or has an earlier match."""
    # looked up by place, so that a hot line is no hot key
    staying = firsts.join(gone, [*PLACE, *SIGNS], "left_anti")
    return gram_sets(docs, width, percent, "none", lines=True).join(staying, [*PLACE, *SIGNS], "left_anti").select("doc", "h", "line")


def _hashed_docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, h): ids that are not null, texts with null as empty, and what tells texts of one id apart."""
    text = text_or_empty(text_col)
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), text_hash(text).alias("h"))


def later_matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc, h, line) of each line that has an earlier match: a line of Jaccard >= percent/100 in a smaller id, or before it in its text. ``h`` is the hash of its text.

    A line's tokens are its distinct ``width``-word shingles (all its words as one if fewer; A-Z
    lower-cased). Lines without words match nothing. Lines are judged on the input, whether or not their
    match goes too. Equal token sets become one first, the earliest standing for them. Tokens are ordered
    by rarity; the rare-first prefix, positional and length filters give pairs, and whole sets verify
    them. Each set is tried against the earliest in its columns; only sets that this leaves without a
    match are then joined with all earlier ones.

    Null texts are empty; null ids match nothing. Different texts of one id stand side by side: none is
    before the other, but a line of one that is like an earlier line (by number) of the other goes. An
    empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    docs = _hashed_docs(df, id_col, text_col)
    return _removed(docs, *_firsts_and_matches(docs, width, percent), width, percent)


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text)


def _line_lists(places: DataFrame, name: str) -> DataFrame:
    """(of, ``name``): the line numbers of each document, gathered where they are dealt to."""
    return places.select(F.col("doc").alias("of"), "line").repartition("of").groupBy("of").agg(F.collect_list("line").alias(name))


def without_later_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Every row with ``n_lines``, ``n_removed`` and its text without lines that have an earlier match (see :func:`later_matches`).

    A text that loses all its lines is empty; a null text stays null with 0 lines. Rows that repeat an id
    lose the lines of their own text only. Columns of the output's names are replaced.

    Where an id has one text, its lines with words go but for those that are first of their set and have no
    match: their shingles are not made again. Lines of ids with several texts are told apart by their sets.
    """
    bounded_batches(df.sparkSession)
    docs = _hashed_docs(df, id_col, text_col)
    firsts, matches = _firsts_and_matches(docs, width, percent)
    several = written(docs.groupBy("doc").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(F.col("doc").alias("of")), "line-several")
    # lines are split before the joins, so that they are not split anew for each line that stays
    packed = df.select(F.struct(*(c for c in df.columns if c.lower() != text_col.lower())).alias("row"), F.col(id_col).cast("long").alias("id"), text_hash(text_or_empty(text_col)).alias("own"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    same, numbers = F.col("id") == F.col("of"), F.sequence(F.lit(0), F.size("lines") - 1)
    listed = packed.join(several, same, "left_anti").join(_line_lists(firsts, "firsts"), same, "left").drop("of").join(_line_lists(matches, "matches"), same, "left")
    worded = F.filter(numbers, lambda i: F.btrim(F.get("lines", i), F.lit(" \t\n\x0b\f\r")) != "")
    no_lines = F.array().cast("array<int>")
    later = F.array_except(worded, F.array_except(F.coalesce("firsts", no_lines), F.coalesce("matches", no_lines)))
    joined = listed.select("row", "lines", F.when(F.col("id").isNotNull() & F.col("lines").isNotNull(), later).alias("gone"))
    if not several.isEmpty():
        mixed = docs.join(several, F.col("doc") == F.col("of"), "left_semi")
        gone = _removed(mixed, firsts, matches, width, percent).groupBy("doc", "h").agg(F.collect_set("line").alias("gone"))
        apart = packed.join(several, same, "left_semi").join(gone, (F.col("id") == F.col("doc")) & (F.col("own") == F.col("h")), "left")
        joined = joined.unionByName(apart.select("row", "lines", "gone"))
    places = F.array_except(numbers, "gone")
    out = joined.select(
        "row",
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.array_join(F.when(F.col("gone").isNull() | (F.size("gone") == 0), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i))), "\n").alias(text_col),
    )
    return outputs_over("row", out, ["n_lines", "n_removed", text_col])
