"""Removal of byte strings that an earlier document has: a difference cover of positions, sorted, and neighbours compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import bounded_batches, freed, outputs_over, text_or_empty, written
from tidewater.llm.suffix_cover import least_owner
from tidewater.llm.windows import Rolling, cover

_SPANS = "doc long, h long, lo int, n int, at int, open boolean"
_SAMPLES = "part int, docs array<long>, hs array<long>, data binary"
_CONTEXTS = "part int, docs array<long>, hs array<long>, data binary, texts binary"
_SAMPLE = np.dtype([("gram", "<u4"), ("context", "<u8"), ("doc", "<u4"), ("lo", "<u4"), ("n", "<u2"), ("at", "<u2"), ("known", "u1")])
_PLACE = np.dtype([("gram", "<u4"), ("doc", "<u4"), ("lo", "<u4"), ("n", "<u2")])

#: Records (samples or windows) that a task sorts at once.
_AT_ONCE = 1 << 19


_RISING = ("doc", "lo")  # mostly in order: differences hold fewer bytes


def _columns(records: np.ndarray) -> bytes:
    """Records by field and then by byte of the field, which compresses better than row by row."""
    out = []
    for name in records.dtype.names:
        field = records[name]
        field = np.diff(field, prepend=field.dtype.type(0)) if name in _RISING else np.ascontiguousarray(field)
        out.append(field.view(np.uint8).reshape(len(field), field.itemsize).T.tobytes())
    return b"".join(out)


def _records(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for name in kind.names:
        width = kind[name].itemsize
        field = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind[name])[:, 0]
        out[name] = np.cumsum(field, dtype=kind[name]) if name in _RISING else field
        at += n * width
    return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 1_000_000):
    """(rows, texts) of about ``most`` bytes together; a longer text comes alone."""
    for batch in batches:
        texts = [t.encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        begin = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if texts:
            yield batch.slice(begin), texts[begin:]


def _first_of_class(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, class of each in order, smallest document of its class) of records sorted by keys and document."""
    order = np.lexsort([doc, *reversed(keys)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    number = np.cumsum(new) - 1
    return order, number, doc[order][np.flatnonzero(new)][number]


def _sampler(parts: int, width: int, gram: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts -> samples by part of their name; of equal samples in a chunk only the smallest document's is left open."""
        for rows, texts in _chunks(batches):
            ids, hs = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc", "h"))
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            names = Rolling(data, 0).all_of(gram)
            at, lo, n = cover(names, ends, len(data), width, gram)
            if not len(at):
                continue
            name = names[at]
            del names
            owner = np.searchsorted(ends, lo, "right")
            out = np.empty(len(at), _SAMPLE)
            out["gram"], out["context"] = name >> np.uint64(32), Rolling(data, 1).of(lo, lo + n + width - 1) ^ (at - lo).astype(np.uint64)
            out["doc"], out["lo"], out["n"], out["at"] = owner, lo - np.append(0, ends)[owner], n, at - lo
            order, _, least = _first_of_class([name, out["context"]], ids[owner])
            out["known"][order] = ids[owner][order] > least
            part = (name & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
            by = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[by])) + 1
            for piece in np.split(by, cuts):
                found, place = np.unique(out["doc"][piece], return_inverse=True)
                records = out[piece]
                records["doc"] = place
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[piece[0]])], pa.int32()), pa.array([ids[found]]), pa.array([hs[found]]), pa.array([_columns(records)], pa.binary())], names=["part", "docs", "hs", "data"]
                )

    return sampled


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype):
    """All records of a part with their documents, and their texts if there are any."""
    found, ids, hs, texts = [], [], [], []
    for batch in batches:
        for row in range(batch.num_rows):
            records = _records(batch.column(3)[row].as_buffer().to_pybytes(), kind)
            found.append(records)
            for out, column in ((ids, 1), (hs, 2)):
                out.append(batch.column(column)[row].values.to_numpy(zero_copy_only=False)[records["doc"]])
            if batch.num_columns > 4:
                texts.append(batch.column(4)[row].as_buffer().to_pybytes())
    if not found:
        return None
    return np.concatenate(found), np.concatenate(ids), np.concatenate(hs), b"".join(texts)


def _spans(ids, hs, lo, n, at, open_) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(ids), 50_000):
        s = slice(k, k + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(hs[s]), pa.array(lo[s].astype(np.int32)), pa.array(n[s].astype(np.int32)), pa.array(at[s].astype(np.int32)), pa.array(open_[s])], names=["doc", "h", "lo", "n", "at", "open"])


def _turns(grams: np.ndarray, weights: np.ndarray) -> Iterator[np.ndarray]:
    """Record numbers in turns of about ``_AT_ONCE`` by weight; records of one name are never parted."""
    turns = int(weights.sum()) // _AT_ONCE + 1
    turn = (grams.astype(np.uint64) * np.uint64(turns)) >> np.uint64(32)
    for k in range(turns):
        yield np.flatnonzero(turn == k)


def _resolve_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples of one part -> covered spans, and the samples whose name has other contexts as well (open)."""
    got = _gathered(batches, _SAMPLE)
    if got is not None:
        records, ids, hs, _ = got
        for turn in _turns(records["gram"], np.ones(len(records), np.int64)):
            yield from _resolved(records[turn], ids[turn], hs[turn])


def _resolved(records: np.ndarray, ids: np.ndarray, hs: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(records):
        return
    order, _, least = _first_of_class([records["gram"], records["context"]], ids)
    records, ids, hs = records[order], ids[order], hs[order]
    covered = (ids > least) | (records["known"] > 0)
    gram, context = records["gram"], records["context"]
    new_gram = np.append(True, gram[1:] != gram[:-1])
    new_class = new_gram | np.append(True, context[1:] != context[:-1])
    group = np.cumsum(new_gram) - 1
    classes = np.bincount(group[new_class])[group]
    open_ = (classes > 1) & ~covered
    out = covered | open_
    yield from _spans(ids[out], hs[out], records["lo"][out], records["n"][out], records["at"][out], open_[out])


def _contexts(parts: int, width: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with their open samples -> these samples' contexts by part of their name."""
        for rows, texts in _chunks(batches):
            places = rows.column(rows.schema.get_field_index("places")).to_pylist()
            ids, hs = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc", "h"))
            doc = np.repeat(np.arange(len(texts)), [len(p) for p in places])
            lo, n, at = (np.array([x[c] for p in places for x in p], np.int64) for c in ("lo", "n", "at"))
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[doc] + lo
            name = Rolling(np.frombuffer(b"".join(texts), np.uint8), 0).of(starts + at, starts + at + gram)
            part = (name & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
            by = np.argsort(part, kind="stable")
            for piece in np.split(by, np.flatnonzero(np.diff(part[by])) + 1) if len(by) else []:
                found, place = np.unique(doc[piece], return_inverse=True)
                records = np.empty(len(piece), _PLACE)
                records["gram"], records["doc"], records["lo"], records["n"] = name[piece] >> np.uint64(32), place, lo[piece], n[piece]
                body = b"".join(texts[d][a : a + k + width - 1] for d, a, k in zip(doc[piece].tolist(), lo[piece].tolist(), n[piece].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[piece[0]])], pa.int32()), pa.array([ids[found]]), pa.array([hs[found]]), pa.array([_columns(records)], pa.binary()), pa.array([body], pa.binary())], names=["part", "docs", "hs", "data", "texts"]
                )

    return cut


def _merge_windows(width: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of one part -> spans of windows that a smaller document has, by sorting all their suffixes to ``width`` bytes."""
        got = _gathered(batches, _PLACE)
        if got is None:
            return
        records, ids, hs, body = got
        sizes = records["n"].astype(np.int64) + width - 1
        ends = np.cumsum(sizes)
        for turn in _turns(records["gram"], sizes):
            text = b"".join(body[b - s : b] for b, s in zip(ends[turn].tolist(), sizes[turn].tolist(), strict=True))
            yield from windows(records[turn], ids[turn], hs[turn], text)

    def windows(records: np.ndarray, ids: np.ndarray, hs: np.ndarray, body: bytes) -> Iterator[pa.RecordBatch]:
        if not len(records):
            return
        n = records["n"].astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n + width - 1)[:-1]])
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        begin = starts[owner] + step
        doc = ids[owner]
        covered = doc > least_owner(np.frombuffer(body, np.uint8), begin, doc, width)
        hit = np.flatnonzero(covered)
        if not len(hit):
            return
        first = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit][1:] != owner[hit][:-1]))
        head = hit[first]
        length = np.diff(np.append(np.flatnonzero(first), len(hit)))
        who = owner[head]
        yield from _spans(ids[who], hs[who], records["lo"][who].astype(np.int64) + step[head], length, np.zeros(len(who), np.int64), np.zeros(len(who), bool))

    return merged


def repeated_spans(docs: DataFrame, width: int = 50, gram: int = 24) -> DataFrame:
    """(doc, h, lo, end) byte spans, which may overlap, of all ``width``-byte strings that a smaller document has too.

    ``docs``: (doc, h, text), rows told apart by doc and h. Method, after the difference-cover algorithm:

    1. Texts are dealt out by content: each window samples a position, at the same offset in equal windows
       (:func:`cover`), so that equal windows come together. Samples are named by hash, dealt out by name
       and sorted by name, context (a hash of the bytes of all windows that sample the position) and
       document. Equal neighbours in the sort but the first are covered whole, and need no more sorting.
       Before they are dealt, equal samples of one chunk of input are reduced to one that has to be
       settled, so a hot string costs one record a chunk.
    2. Names with one context are settled. For names with several contexts, the contexts' bytes are dealt
       out by name, and the suffixes of each part sorted to the depth of ``width`` bytes by a difference
       cover (:func:`least_owner`): sampled triples are sorted and named, triples of names after them, the
       other suffixes merged at common offsets, and neighbours' bytes compared.

    The number of parts is that of shuffle partitions; a task holds one part's samples, of about
    2 / (width - gram + 2) of the bytes, never a document group, and sorts about half a million at once.
    A name that very many different contexts share stays in one part.
    """
    if not 1 <= gram <= width <= 60_000:
        raise ValueError("1 <= gram <= width <= 60000 must hold")
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    samples = docs.mapInArrow(_sampler(parts, width, gram), _SAMPLES)
    settled = written(samples.repartitionById(parts, F.col("part")).mapInArrow(_resolve_samples, _SPANS), "substring-samples")
    del samples
    freed(spark)
    places = settled.where("open").groupBy("doc", "h").agg(F.collect_list(F.struct("lo", "n", "at")).alias("places"))
    contexts = docs.join(places, ["doc", "h"]).select("doc", "h", "text", "places").mapInArrow(_contexts(parts, width, gram), _CONTEXTS)
    merged = written(contexts.repartitionById(parts, F.col("part")).mapInArrow(_merge_windows(width), _SPANS), "substring-windows")
    del contexts, places
    freed(spark)
    return settled.where("not open").unionByName(merged).select("doc", "h", "lo", (F.col("lo") + F.col("n") + width - 1).alias("end"))


_CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])


def _cut(text: bytes, spans) -> tuple[int, int, list[bytes]]:
    """(removed bytes, maximal removed runs, kept parts)."""
    kept, removed, runs, at = [], 0, 0, 0
    for lo, end in sorted((s["lo"], s["end"]) for s in spans):
        if end <= at and runs:
            continue
        if lo > at or not runs:
            kept.append(text[at:lo])
            runs += 1
            removed += end - lo
        else:
            removed += end - at
        at = end
    kept.append(text[at:])
    return removed, runs, kept


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int | None = None, keep_bytes: bool = True) -> DataFrame:
    """Every row with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes, null unless ``keep_bytes``) and ``kept_sha256``.

    Removed: each byte of a UTF-8 text that lies in a ``width``-byte string that also starts in a text of a
    smaller id, judged on the input. Matches never cross texts; shorter texts lose nothing. Null texts are
    empty. A null id counts below all others. Rows that repeat an id do not cover each other. A cut may
    fall inside a character, so the rest is bytes. Columns of the output's names are replaced. ``gram``,
    the length of the strings that are sampled and named, is half of ``width`` less one unless given; it
    changes the cost and not the result.
    """
    gram = max(1, width // 2 - 1) if gram is None else gram
    whole = text_or_empty(text_col)
    keyed = df.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    spans = repeated_spans(keyed.select("doc", "h", "text"), width, gram)
    lists = spans.groupBy("doc", "h").agg(F.collect_set(F.struct("lo", "end")).alias("spans"))

    @F.pandas_udf(_CUT)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, spans, strict=True):
            text = text.encode()
            removed, runs, kept = _cut(text, [] if found is None else found)
            kept = b"".join(kept)
            rows.append((len(text), removed, runs, kept if keep_bytes else None, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=_CUT.fieldNames())

    joined = keyed.join(lists, ["doc", "h"], "left").select("row", cut("text", "spans").alias("cut"))
    return outputs_over("row", joined.select("row", "cut.*"), _CUT.fieldNames())
