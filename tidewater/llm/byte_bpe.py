"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.ragged import Numbering, PairTable, row_starts, slices
from tidewater.llm.shared import outputs_over, text_or_empty


class ByteVocabulary:
    """Byte strings by rank, and the pairs that merge into them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.rank = rank
        self.bytes_of = {r: token for token, r in rank.items()}
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        self.early = np.zeros(max(rank.values()) + 1, bool)
        for token, r in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(r)
                    # a merge that makes a or b can be followed by a merge of a rank below its own
                    self.early[a] |= r < a
                    self.early[b] |= r < b
        self.pairs = PairTable(left, right, merged, merged)


class RankQueue:
    """Buckets of positions by merge rank under three levels of 64-bit words; find-first-set gives the next rank."""

    def __init__(self, ranks: int):
        self.levels = [[0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), [0] * (ranks // 262144 + 1)]
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: np.ndarray, position: np.ndarray) -> None:
        """Adds the positions to the buckets of their ranks."""
        if not len(rank):
            return
        if len(rank) > 1:
            order = np.argsort(rank, kind="stable")
            rank, position = rank[order], position[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(position, cuts), strict=True):
            self.put(r, part)

    def put(self, r: int, part: np.ndarray) -> None:
        self.buckets.setdefault(r, []).append(part)
        for level in self.levels:
            level[r >> 6] |= 1 << (r & 63)
            r >>= 6

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions in order; the bucket is then empty."""
        at = 0
        for words in reversed(self.levels):
            word = words[at] if at < len(words) else 0
            if not word:
                return None
            at = at << 6 | (word & -word).bit_length() - 1
        parts = self.buckets.pop(at)
        r = at
        for level in self.levels:
            level[r >> 6] &= ~(1 << (r & 63))
            if level[r >> 6]:
                break
            r >>= 6
        position = np.sort(np.concatenate(parts))
        return at, position[np.append(True, position[1:] != position[:-1])]


def encode_pieces(pieces: list[bytes], vocabulary: ByteVocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces end to end, and the number of ids of each.

    The bytes of all pieces form one linked list of symbols with a wall between pieces. The queue holds
    the left position of every pair that merges. The lowest rank's bucket is emptied at once: stale
    entries (the pair there has changed) are skipped, of overlapping pairs the leftmost merge, and pairs
    beside a merge are pushed. Where a merge can be followed by one of a lower rank, only the leftmost of
    each piece is made before the queue is asked again. A piece that is itself a token is never split.
    """
    pairs, top = vocabulary.pairs, len(vocabulary.early)
    lengths = np.array([len(p) for p in pieces], np.int64)
    starts = row_starts(lengths)
    total = int(starts[-1])
    ids = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    index = np.arange(total)
    after = np.where(np.append(owner[1:] == owner[:-1], False), index + 1, -1) if total else index
    before = np.where(np.append(True, owner[1:] != owner[:-1]), -1, index - 1) if total else index
    alive = np.ones(total, bool)
    for i, r in enumerate(map(vocabulary.rank.get, pieces)):
        if r is not None and lengths[i] > 1:
            a, b = starts[i], starts[i + 1]
            ids[a], after[a], alive[a + 1 : b] = r, -1, False
            after[a + 1 : b] = -1
    rank, merged = np.full(total, PairTable.NONE, np.int64), np.full(total, -1, np.int64)

    def look(at: np.ndarray) -> np.ndarray:
        nxt = after[at]
        rank[at], merged[at] = pairs.find(np.where(nxt >= 0, ids[at], -1), ids[np.maximum(nxt, 0)])
        return at[rank[at] < PairTable.NONE]

    queue = RankQueue(top)
    found = look(index[alive])
    queue.push(rank[found], found)
    while (taken := queue.pop()) is not None:
        r, at = taken
        at = at[alive[at] & (rank[at] == r)]  # stale entries go
        if not len(at):
            continue
        if vocabulary.early[r] and len(at) > 1:
            first = np.append(True, owner[at][1:] != owner[at][:-1])
            if not first.all():
                queue.put(r, at[~first])
                at = at[first]
        if len(at) > 1:  # of a run in which one pair ends where the next begins, every other one
            fresh = np.append(True, after[at[:-1]] != at[1:])
            run = np.arange(len(at))
            at = at[(run - np.maximum.accumulate(np.where(fresh, run, 0))) % 2 == 0]
        gone = after[at]
        ids[at] = merged[at]
        alive[gone] = False
        rank[gone] = PairTable.NONE
        after[at] = after[gone]
        follows = after[at]
        before[follows[follows >= 0]] = at[follows >= 0]
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        # a neighbour that merged in this round lies between: its list is already joined
        beside = np.concatenate([at, ahead[alive[ahead]]])
        found = look(beside)
        queue.push(rank[found], found)
    counts = np.bincount(owner[alive], minlength=len(pieces)) if total else np.zeros(len(pieces), np.int64)
    return ids[alive], counts


def _plain_pattern(pattern: str) -> tuple[object, object]:
    """The pattern for any text, and the standard library's twin for texts of Latin letters, digits and ASCII signs."""
    letters, digits = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
    twin = pattern.replace(r"\p{L}", letters).replace(r"\p{N}", digits)
    parts = {r" ?\p{L}+": f" ?[{letters}]+", r" ?\p{N}+": f" ?[{digits}]+", r" ?[^\s\p{L}\p{N}]+": rf" ?[^\s{letters}{digits}]+"}
    if set(parts) <= set(pattern.split("|")):
        twin = "|".join(parts.get(p, p) for p in pattern.split("|"))
        return regex.compile(pattern), (re.compile(twin), re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*"))
    return regex.compile(pattern), None


_SPACES = regex.compile(r" (?=\S)")
_UNEVEN = re.compile(r" \s| \Z")


class ByteEncoder:
    """Encodes texts by a pattern and ranks; ids of distinct chunks are kept up to ``most`` chunks.

    A chunk is a text's part before a space that a non-space follows. With the pattern's ``" ?X+"`` and
    ``"\\s+(?!\\S)"`` branches such a space always starts a match, so chunks are matched alone.
    """

    def __init__(self, path: str, pattern: str, most: int = 250_000):
        self.vocabulary, self.most = ByteVocabulary(path), most
        self.pattern, self.twin = _plain_pattern(pattern)
        self._begin()

    def _begin(self) -> None:
        self.numbers = Numbering()
        self.listed: list[str] = []  # a chunk's ids as text
        self.decoded: list[bytes] = []
        self.sizes = np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        if self.twin and (text.isascii() and text.isprintable() or self.twin[1].fullmatch(text)):
            return self.twin[0].findall(text)
        return self.pattern.findall(text)

    def _number(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > self.most:
            self._begin()
        known = len(self.numbers)
        numbered = []
        for text in texts:
            chunks = _SPACES.split(text) if _UNEVEN.search(text) else text.split(" ")
            if chunks[0]:
                chunks[0] = " " + chunks[0]  # no other chunk starts with a space: the one that does has none before it
            else:
                del chunks[0]
            numbered.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks)))
        new = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        if new:
            self._encode([c[1:] if c[0] == " " else " " + c for c in new])
        return numbered

    def _encode(self, chunks: list[str]) -> None:
        """Adds the ids of new chunks, whose pieces are encoded together."""
        pieces, counts = [], []
        for chunk in chunks:
            found = self.pieces(chunk)
            pieces += found
            counts.append(len(found))
        ids, sizes = encode_pieces([p.encode() for p in pieces], self.vocabulary)
        sizes = np.add.reduceat(sizes, row_starts(np.array(counts))[:-1])
        bounds, bytes_of = row_starts(sizes).tolist(), self.vocabulary.bytes_of.__getitem__
        names, ids = list(map(str, ids.tolist())), ids.tolist()
        for a, b in pairwise(bounds):
            self.listed.append(",".join(names[a:b]))
            self.decoded.append(b"".join(map(bytes_of, ids[a:b])))
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [[int(i) for n in row.tolist() for i in self.listed[n].split(",")] for row in self._number(texts)]

    def decode(self, rows: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids."""
        return [b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)) for ids in rows]

    def digests(self, texts: list[str]) -> pd.DataFrame:
        """n_tokens, the digest of the ids in decimal with commas, the digest of the decoded bytes."""
        out = []
        for row in self._number(texts):
            n_tokens, row = int(self.sizes[row].sum()), row.tolist()
            listed = ",".join(map(self.listed.__getitem__, row))
            decoded = b"".join(map(self.decoded.__getitem__, row))
            out.append((n_tokens, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Every row with ``ids`` array<int> and ``decoded`` binary. Null text counts as empty: no ids, no bytes."""
    result = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    @F.pandas_udf(result)
    def coded(texts: pd.Series) -> pd.DataFrame:
        encoder = _encoder(ranks_path, pattern)
        ids = encoder.encode(texts.tolist())
        return pd.DataFrame({"ids": ids, "decoded": encoder.decode(ids)})

    packed = df.select(F.struct("*").alias("row"), coded(text_or_empty(text_col)).alias("coded"))
    return outputs_over("row", packed.select("row", "coded.ids", "coded.decoded"), ["ids", "decoded"])


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Every row with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of its whole text.

    The digests are of the decimal ids joined by commas and of the bytes that the ids decode to. Null
    text counts as empty. Memory holds one Arrow batch and a bounded number of chunks. Columns of the
    output's names are replaced.
    """
    result = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.pandas_udf(result)
    def digests(texts: pd.Series) -> pd.DataFrame:
        return pd.concat([_encoder(ranks_path, pattern).digests(part) for part in slices(texts.tolist())], ignore_index=True)

    packed = df.select(F.struct("*").alias("row"), digests(text_or_empty(text_col)).alias("coded"))
    return outputs_over("row", packed.select("row", "coded.*"), ["n_tokens", "ids_sha256", "decoded_sha256"])
