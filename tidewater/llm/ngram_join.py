"""Jaccard join of documents on word n-grams as a blocked sparse product of their incidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.set_join import SIGNS, as_smaller, central_tries, distinct_sets, gram_sets, may_have_links, numbered_sets, open_rows, overlap_counts, pairs_ahead, rare_prefixes, verified
from tidewater.llm.shared import bounded_batches, freed, outputs_over, text_or_empty, written


def set_links(prefixes: DataFrame, sets: DataFrame, percent: int, turns: bool = True) -> DataFrame:
    """Verified links (a, b) between set ids that connect all sets that links connect.

    Each set is checked against one leader, with the largest overlap counted over columns
    (:func:`central_tries`), and again with other leaders while the pairs ahead outnumber the incidence
    rows and fall by a tenth at least (``turns``). Then only columns whose sets are not yet in one
    component are multiplied out, in blocks of columns, only between components, adding up overlaps by
    pair and discarding cells and pairs below the bounds that sizes and places give
    (:func:`overlap_counts`). A family whose members no leader links falls to that product, which is
    complete, and quadratic in what is left of it. All pairs are verified on whole sets, so no link is
    wrong and no component is missed.
    """
    links = written(verified(central_tries(prefixes.withColumn("of", F.col("id")), 0), sets, percent), "set-stars")
    rest = written(open_rows(prefixes, components(links)), "set-open")
    rows, ahead = pairs_ahead(rest, percent)
    turn = 0
    while turns and ahead > rows:
        turn, before = turn + 1, ahead
        links = written(links.unionByName(verified(central_tries(rest, turn), sets, percent)), "set-stars")
        rest = written(open_rows(prefixes, components(links)), "set-open")
        rows, ahead = pairs_ahead(rest, percent)
        if 10 * ahead > 9 * before:
            break
    one = rest.where(as_smaller(percent)).select("g", F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("of").alias("fa"))
    two = rest.select("g", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("of").alias("fb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = overlap_counts(one, two, smaller & (F.col("fa") != F.col("fb")), percent)
    return links.unionByName(verified(pairs, sets, percent))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, turns: bool = True) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (the smallest id reachable by links of Jaccard >= percent/100).

    Method: rows of equal sets become one, the smallest id standing for them. The document-by-n-gram
    incidence is multiplied out in blocks of columns: first by document alone, adding up the columns that
    each shares with any other, which discards documents (:func:`may_have_links`), then columns
    (:func:`rare_prefixes`), then pairs (:func:`set_links`) below the bounds that sizes give.

    Null, empty and blank texts have an empty set, are linked with nothing and are their own component.
    Texts are read whole. Rows that repeat an id count as one document with several texts. A null id
    links with nothing and has a null component. ``turns``: see :func:`set_links`; the result is the same.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    reps = distinct_sets(docs, width, percent)
    freed(df.sparkSession)
    sets = numbered_sets(docs, may_have_links(reps, percent), width, percent)
    prefixes = rare_prefixes(sets, percent)
    freed(df.sparkSession)
    links = written(set_links(prefixes, sets, percent, turns), "set-links")
    names = sets.select("id", "doc")
    linked = links.join(names.select(F.col("id").alias("a"), F.col("doc").alias("da")), "a").join(names.select(F.col("id").alias("b"), F.col("doc").alias("db")), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    first = reps.select(*SIGNS, F.col("doc").alias("rep"))
    base = written(gram_sets(docs, width, percent, "none").select("doc", *SIGNS).join(first, SIGNS, "left").select("doc", "n", "rep"), "set-rows")
    several = base.where("rep is not null and doc is not null").groupBy("doc").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc")
    own = base.join(several, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    found = components(linked.unionByName(own))
    keyed = base.withColumn("of", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")))
    return keyed.join(found, F.col("of") == F.col("node"), "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "of").alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stand for their group, with all columns: the smallest id of each component."""
    kept = near_groups(df, id_col, text_col, width, percent).where("component_id = doc_id or doc_id is null").select(F.col("doc_id").alias("kept_id")).distinct()
    packed = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return outputs_over("row", packed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi"), [])
