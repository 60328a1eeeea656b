"""Order-independent fingerprints of documents: sums of wide vectors hashed from paragraphs, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import outputs_over, text_or_empty

#: A lane holds a sum modulo 2^32. Lane 1 counts sentences; EVEN lanes tell multisets of paragraphs apart; SIGNED lanes count sentence hashes with a given bit.
MASK, BOTH, EVEN, SIGNED = (1 << 32) - 1, (1 << 32) + 1, 8, 128
LANES = 1 + EVEN + SIGNED
PARAGRAPH, SENTENCE = r"\r?\n", r"(?<=[.!?])\s+|\r?\n"
LOWEST = -(2**63)


def _added(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, h: total + term(h))


def _seeded(k: int):
    return lambda x: F.xxhash64(F.lit(k), x)


def with_fingerprint(df: DataFrame, text_col: str, output: str) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` (null: empty) as an array of ``LANES`` longs, each below 2^32.

    A paragraph (what stands between line breaks, if anything) is hashed to a wide vector: 8 uniform lanes
    of 32 bits from four 64-bit hashes of the whole paragraph, and 128 lanes to which each of its
    sentences adds one bit of two more hashes. A document's fingerprint is the sum of its paragraphs'
    vectors modulo 2^32 in each lane: their order does not matter, and paragraphs are inserted or deleted
    by adding or subtracting vectors (see :func:`inserted`, :func:`deleted`). Texts with the same
    paragraphs have the same fingerprint; others differ but for a chance of about 2^-256.

    Two bit lanes are added at once in the halves of a long: a text has fewer than 2^31 sentences. Helper
    columns carry names that start with ``output``; columns of ``df`` with such names are replaced.
    """
    text = text_or_empty(text_col)
    named = lambda k: f"{output}__{k}"
    blank = F.lit("")
    parts = df.withColumns({named("p"): F.filter(F.split(text, PARAGRAPH), lambda x: x != blank), named("s"): F.filter(F.split(text, SENTENCE), lambda x: x != blank)})
    hashed = parts.withColumns({named(k): F.transform(named("p" if k < EVEN // 2 else "s"), _seeded(k)) for k in range(EVEN // 2 + SIGNED // 64)})
    even = [half for k in range(EVEN // 2) for half in (_added(F.col(named(k)), lambda h: h.bitwiseAND(F.lit(MASK))), _added(F.col(named(k)), lambda h: F.shiftrightunsigned(h, 32)))]
    bits = [_added(F.col(named(EVEN // 2 + k)), lambda h, i=i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(BOTH))) for k in range(SIGNED // 64) for i in range(32)]
    sums = hashed.withColumn(named("sums"), F.array(*bits))
    halves = F.flatten(F.transform(named("sums"), lambda x: F.array(x.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(x, 32))))
    lanes = F.concat(F.array(F.size(named("s")).cast("long"), *(x.bitwiseAND(F.lit(MASK)) for x in even)), halves)
    return sums.withColumn(output, lanes).drop(*(named(k) for k in ["p", "s", "sums", *range(EVEN // 2 + SIGNED // 64)]))


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def as_hex(lanes: Column) -> Column:
    """Eight lowercase hex digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def signs(lanes: Column) -> Column:
    """The signed sums that bit counts stand for: each sentence gives +1 or -1 a lane."""
    n = F.get(lanes, F.lit(0))
    return F.transform(F.slice(lanes, 2 + EVEN, SIGNED), lambda x: (x * 2 - n).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def likeness(same: Column, ab: Column, aa: Column, bb: Column) -> Column:
    """From 0 to 1: twice the estimated shared sentences over both texts' sentences (the inner products of random signs have these means); 1 where fingerprints are equal."""
    return F.when(same, 1.0).when(aa + bb <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * ab / (aa + bb))))


def _order_ranges(keys: DataFrame, parts: int) -> tuple[Column, Column]:
    """The highest (id, tie) of each range of a descending range sort, as two array literals from high to low; at most ``parts`` of them."""
    tops = keys.repartitionByRange(parts, F.desc("id"), F.desc("tie")).groupBy(F.spark_partition_id()).agg(F.max(F.struct("id", "tie")).alias("top")).collect()
    ordered = sorted(((r.top.id, r.top.tie) for r in tops), reverse=True)
    return tuple(F.split(F.lit(",".join(str(t[k]) for t in ordered)), ",").cast("array<bigint>") for k in (0, 1))


def with_next(df: DataFrame, id_col: str, carried: list[str], tie_col: str) -> DataFrame:
    """``df`` with struct ``next``: columns ``carried`` of the row with the next smaller id (after the last: of the first).

    Rows of one id follow by a hash of ``tie_col``, a column of the table that is read and not computed, as
    it is read again for the ranges. Ranges of (id, hash) of even size come from a
    range sort of these two alone; their upper ends, a few numbers a range, are literals in the plan, and
    each row finds its range by bisection. The rows travel once, to their range; the first row of a range
    also goes to the range before it, so that no range waits for another. Null ids come last.
    """
    keyed = df.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(tie_col).alias("tie"))
    parts = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids, ties = _order_ranges(keyed.select("id", "tie"), parts)
    under = lambda at: (F.col("id") < F.get(ids, at)) | ((F.col("id") == F.get(ids, at)) & (F.col("tie") <= F.get(ties, at)))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(32))))
    found = keyed.withColumn("range", F.aggregate(steps.cast("array<bigint>"), F.lit(0).cast("long"), lambda at, step: F.when((at + step < F.size(ids)) & under((at + step).cast("int")), at + step).otherwise(at)))
    at = F.col("range").cast("int")
    top = (F.col("id") == F.get(ids, at)) & (F.col("tie") == F.get(ties, at))
    before = F.pmod(F.col("range") - 1, F.size(ids))
    one = lambda at, guest: F.struct(at.alias("range"), F.lit(guest).alias("guest"))
    dealt = found.withColumn("to", F.explode(F.when(top, F.array(one(F.col("range"), False), one(before, True))).otherwise(F.array(one(F.col("range"), False)))))
    order = Window.partitionBy("to.range").orderBy("to.guest", F.desc("id"), F.desc("tie"))
    return dealt.withColumn("next", F.lead(F.struct(*(F.col("row")[c].alias(c) for c in carried))).over(order)).where("not to.guest").select("row.*", "next")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next document in descending id (see :func:`with_next`; one document alone follows itself).
    Fingerprints are lanes in hex (see :func:`with_fingerprint`); the likenesses compare a document's with
    that of its edited text and that of the next document.

    Null text counts as empty: no paragraphs, all lanes zero, and alike only to texts without any. Null
    ids come after all others; repeated rows are documents of their own, and follow each other. Columns of
    the output's names are replaced. An empty table gives no rows.
    """
    # the text travels once: it stands beside the other columns
    others = [c for c in df.columns if c.lower() != text_col.lower()]
    packed = df.select(F.struct(*others).alias("source"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = with_next(with_fingerprint(packed, "text", "own"), "id", ["text", "own"], "text")
    whole, after = text_or_empty("text"), text_or_empty("next.text")
    half = F.floor(F.length(whole) / 2).cast("int")
    edited = own.withColumn("edited", F.concat(F.substring(whole, F.lit(1), F.length(whole) - half), F.substring(after, F.lit(1), half)))
    printed = with_fingerprint(edited, "edited", "other").select("source", "text", F.length(whole).cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "other", F.col("next.own").alias("after"))
    signed = printed.withColumns({f"{c}_signs": signs(F.col(c)) for c in ("own", "other", "after")})
    products = signed.withColumns({"oo": dot(F.col("own_signs"), F.col("own_signs"))} | {f"{c}_{k}": dot(F.col(f"{c}_signs"), F.col(f"{by}_signs")) for c in ("other", "after") for k, by in (("own", "own"), ("self", c))})
    out = products.select(
        "source",
        F.col("text").alias(text_col),
        "n_chars",
        "edited_sha256",
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("other")).alias("edited_fingerprint"),
        *(likeness(F.col("own") == F.col(c), F.col(f"{c}_own"), F.col("oo"), F.col(f"{c}_self")).alias(n) for c, n in (("other", "near_edited"), ("after", "near_next"))),
    )
    return outputs_over("source", out, [text_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def collection_fingerprint(df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    """(by..., fingerprint) of all documents of a group together, as lanes: sums of documents' fingerprints, added map-side first."""
    lanes = with_fingerprint(df.select(*by, F.col(text_col).alias("text")), "text", "own")
    sums = lanes.groupBy(*by).agg(*(F.sum(F.get("own", F.lit(k)).cast("decimal(20,0)")).alias(f"lane{k}") for k in range(LANES)))
    return sums.select(*by, F.array(*((F.col(f"lane{k}") % (1 << 32)).cast("long") for k in range(LANES))).alias("fingerprint"))
