"""Text of documents and pages: lines, furniture, numbers, overlaps, tables of HTML and facts of XML."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy_lines(text: Column) -> Column:
    """Stripped lines; three or more spaces inside become a cell border, two become one; blank lines go."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), " {3,}", " | "), " {2}", " "))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(page )?[0-9]{1,4}( of [0-9]{1,4})?$"))


def furniture(pages: DataFrame, doc: str, text: str, edge: int = 3, least_pages: int = 3) -> DataFrame:
    """(doc, line, pages): lines that stand at the edge of at least ``least_pages`` pages (cut by form feeds)."""
    return page_furniture(pages.select(doc, F.posexplode(F.split(text, "\f", -1)).alias("page", "body")), doc, "page", "body", edge, least_pages)


def page_furniture(pages: DataFrame, doc: str, page: str, text: str, edge: int = 3, least_pages: int = 3) -> DataFrame:
    """``furniture`` where each page is a row of its own: no text is gathered, only edge lines are shuffled."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.lower(F.trim(x)), "[0-9]+", "#")), lambda x: x != "")
    ends = pages.select(doc, page, F.explode(F.array_distinct(F.concat(F.slice(lines, 1, edge), F.when(F.size(lines) > 0, F.slice(lines, F.greatest(F.lit(1), F.size(lines) - edge + 1), F.lit(edge))).otherwise(F.array().cast("array<string>"))))).alias("line"))
    return ends.groupBy(doc, "line").agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least_pages)


def numbers_in(text: Column) -> Column:
    """Numbers of a text with their separators, in order."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[,.][0-9]+)*"), F.lit(0))


def repeated_lines(docs: DataFrame, doc: str, text: str, least_docs: int = 2) -> DataFrame:
    """(line, docs, n): lines that stand in several documents."""
    lines = docs.select(doc, F.explode(F.split(text, "\n", -1)).alias("line")).where("trim(line) <> ''")
    per = lines.groupBy("line", doc).agg(F.count("*").alias("n"))
    return per.groupBy("line").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs)


def word_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the smaller text's distinct words."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")) for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))


def _overlaps_within(band: int, least: float):
    """Rows (id, at, own, words) of a block and the one before it -> (a, b, overlap) of the pairs whose later row is the block's own.

    Words become numbers that are exact within these rows; a row's words are marked once, and looked up for all rows of its band together.
    """

    def pairs(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("at", "ascending"), ("id", "ascending")])).combine_chunks()
        ids, at, own = rows["id"], rows["at"].to_numpy(), rows["own"].to_numpy()
        codes = pa.concat_arrays([x.flatten() for x in rows["words"].chunks]).dictionary_encode().indices.to_numpy()
        sizes = pc.list_value_length(rows["words"]).to_numpy().astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        again = np.append(False, pc.equal(ids[1:], ids[:-1]).to_numpy() & (at[1:] == at[:-1]))  # rows of one id and place are no pair
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
        marked = np.zeros(codes.max() + 1, bool)
        found = []
        for b in np.flatnonzero(own):
            lo, hi = int(np.searchsorted(at, at[b] - band)), int(head[b])
            if lo < hi:
                words = codes[starts[b] : starts[b + 1]]
                marked[words] = True
                shared = np.add.reduceat(marked[codes[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
                marked[words] = False
                share = shared / np.minimum(sizes[lo:hi], sizes[b])
                kept = np.flatnonzero(share >= least)
                found.append((lo + kept, np.full(len(kept), b), share[kept]))
        one, two, share = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": ids.take(pa.array(one)), "b": ids.take(pa.array(two)), "overlap": share})

    return pairs


def overlap_pairs(docs: DataFrame, doc: str, key: str, order: str, text: str, band: int, least: float) -> DataFrame:
    """(a, b, overlap): every pair of a key at most ``band`` apart in ``order`` (a number) whose word overlap is at least ``least``.

    Orders fall into blocks of ``band``, and a row is dealt to its own block and the next, where the pairs
    are counted: a group is two bands of one key. Texts are cut into words once. Empty texts and null ids
    pair with nothing.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    block = F.floor(F.col(order) / band)
    rows = docs.select(F.col(doc).alias("id"), F.col(key).alias("k"), F.col(order).alias("at"), block.alias("first"), words.alias("words")).where((F.size("words") > 0) & F.col("k").isNotNull() & F.col("first").isNotNull() & F.col("id").isNotNull())
    dealt = rows.select("k", "id", "at", "words", F.explode(F.array(F.struct(F.col("first").alias("block"), F.lit(True).alias("own")), F.struct((F.col("first") + 1).alias("block"), F.lit(False).alias("own")))).alias("to")).select("k", "to.*", "id", "at", "words")
    kind = rows.schema["id"].dataType.simpleString()
    return dealt.groupBy("k", "block").applyInArrow(_overlaps_within(band, least), f"a {kind}, b {kind}, overlap double")


def contains_quote(text: Column, quote: Column) -> Column:
    """``exact`` if the quote stands in the text, ``loose`` if it does without case and spacing, else ``no``."""
    def plain(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))

    return F.when(F.contains(text, quote), "exact").when(F.contains(plain(text), plain(quote)), "loose").otherwise("no")


def html_title(html: Column) -> Column:
    """The text of the title element, trimmed."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_cells(html: Column, tag: str) -> Column:
    """The inner texts of all elements of a tag, without tags inside them."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", " ")))


def html_links(html: Column) -> Column:
    """All href values in order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def html_text(html: Column) -> Column:
    """The text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def xml_facts(xml: Column, tag: str) -> Column:
    """Texts of an XML element by name, whatever its prefix."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), F.lit(1))
