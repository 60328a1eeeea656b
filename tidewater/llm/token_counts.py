"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.ragged import Numbering, PairTable, slices
from tidewater.llm.shared import outputs_over, text_or_empty

SPACE = "▁"


class PieceVocabulary:
    """The pieces of a sentencepiece BPE model as arrays. Only the file is read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = {}
        for i in range(model.get_piece_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)):
                plain[model.id_to_piece(i)] = i
        scores = sorted({model.get_score(i) for i in plain.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        rank = {piece: place[model.get_score(i)] for piece, i in plain.items()}
        self.chars = {piece: i for piece, i in plain.items() if len(piece) == 1}
        left, right, merged, ranks = [], [], [], []
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                a, b = plain.get(piece[:cut]), plain.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i), ranks.append(rank[piece])
        self.pairs = PairTable(left, right, merged, ranks)
        # symbols by code point; an unknown character is -(its UTF-8 bytes) and falls back to so many tokens
        self.symbols = np.repeat(np.array([-1, -2, -3, -4], np.int64), [0x80, 0x780, 0xF800, 0x100000])
        for char, i in self.chars.items():
            self.symbols[ord(char)] = i
        inner = {(piece[k], piece[k + 1]) for piece in plain for k in range(len(piece) - 1)}
        if any(b == SPACE and a != SPACE for a, b in inner):
            raise ValueError("a piece has a space inside it: chunks cannot be cut at spaces")


def _apply(symbols, owner, rank, merged, hits, pairs):
    """Merges the pairs that start at ``hits``; looks up anew only the pairs beside a merge."""
    symbols, rank, merged = symbols.copy(), rank.copy(), merged.copy()
    symbols[hits] = merged[hits]
    kept = np.ones(len(symbols), bool)
    kept[hits + 1] = False
    place = np.cumsum(kept) - 1
    kept = np.flatnonzero(kept)
    symbols, owner, rank, merged = symbols[kept], owner[kept], rank[kept], merged[kept]
    at = place[hits]
    beside = np.zeros(len(symbols), bool)
    beside[at] = True
    beside[at[at > 0] - 1] = True
    near = np.flatnonzero(beside)
    follows = np.minimum(near + 1, len(symbols) - 1)
    inside = (near < len(symbols) - 1) & (owner[follows] == owner[near])
    rank[near], merged[near] = pairs.find(np.where(inside, symbols[near], -1), symbols[follows])
    return symbols, owner, rank, merged, near, kept


def merged_counts(chunks: list[str], vocabulary: PieceVocabulary) -> np.ndarray:
    """The number of tokens of each chunk, itself part of a text cut at spaces.

    All chunks lie end to end in one array of symbols. In each round every chunk finds the lowest rank
    among its adjacent pairs and merges all pairs of that rank at once, from the left where they overlap.
    If a pair that comes of it ranks as low or lower, only the leftmost merge of that chunk stands, since
    one at a time the new pair would go before the others. Chunks without a pair leave the arrays.
    """
    pairs, none = vocabulary.pairs, PairTable.NONE
    counts = np.zeros(len(chunks), np.int64)
    lengths = np.array([len(c) for c in chunks], np.int64)
    points = np.frombuffer("".join(chunks).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = vocabulary.symbols[points]
    owner = np.repeat(np.arange(len(chunks)), lengths)
    same = np.append(owner[1:] == owner[:-1], False)
    rank, merged = pairs.find(np.where(same, symbols, -1), np.append(symbols[1:], -1))
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        spread = np.diff(np.append(starts, len(owner)))
        lowest = np.minimum.reduceat(rank, starts)
        best = np.repeat(lowest, spread)
        live = best < none
        if not live.all():  # a chunk without a pair is done
            done = ~live
            counts += np.bincount(owner[done], np.where(symbols[done] < 0, -symbols[done], 1), len(counts)).astype(np.int64)
            symbols, owner, rank, merged, best = symbols[live], owner[live], rank[live], merged[live], best[live]
            if not len(symbols):
                break
        # in a run of overlapping pairs every other one merges, from the left
        hits = np.flatnonzero(rank == best)
        fresh = np.append(True, np.diff(hits) != 1)
        run = np.arange(len(hits))
        hits = hits[(run - np.maximum.accumulate(np.where(fresh, run, 0))) % 2 == 0]
        taken = _apply(symbols, owner, rank, merged, hits, pairs)
        new_symbols, new_owner, new_rank, new_merged, near, kept = taken
        early = near[new_rank[near] <= best[kept[near]]]
        if len(early):
            redo = np.zeros(len(counts), bool)
            redo[new_owner[early]] = True
            whose = owner[hits]
            hits = hits[~redo[whose] | np.append(True, whose[1:] != whose[:-1])]
            new_symbols, new_owner, new_rank, new_merged, *_ = _apply(symbols, owner, rank, merged, hits, pairs)
        symbols, owner, rank, merged = new_symbols, new_owner, new_rank, new_merged
    return counts


_WIDE = re.compile("  |▁")
_RUNS = re.compile(" *[^ ]+| +")


def spaced_chunks(text: str) -> list[str]:
    """A text cut before each run of spaces, without the first space of each run (a text starts with one)."""
    if not text:
        return []
    if not _WIDE.search(text) and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(" " + text.replace(SPACE, " "))]


class ChunkCounts:
    """Token counts of the distinct chunks met so far; begun anew beyond ``most`` of them, which bounds its memory."""

    def __init__(self, vocabulary: PieceVocabulary, most: int = 250_000):
        self.vocabulary, self.most = vocabulary, most
        self.numbers, self.tokens = Numbering(), np.zeros(0, np.int64)

    def count_batch(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; the chunks that are new in this batch are merged together."""
        if len(self.numbers) > self.most:
            self.numbers, self.tokens = Numbering(), np.zeros(0, np.int64)
        known = len(self.numbers)
        numbered = [np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks)) for chunks in map(spaced_chunks, texts)]
        new = [" " + chunk for chunk in islice(reversed(self.numbers), len(self.numbers) - known)][::-1]
        if new:
            self.tokens = np.concatenate([self.tokens, merged_counts(new, self.vocabulary)])
        return np.array([self.tokens[n].sum() for n in numbered], np.int64)


@lru_cache(maxsize=2)
def _counts(path: str) -> ChunkCounts:
    return ChunkCounts(PieceVocabulary(path))


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Every row with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Counts are those of the sentencepiece BPE model at ``model_path`` (which every executor can read),
    without added tokens. Null text counts as empty: 0 bytes and 0 tokens. Texts of any length are
    counted whole; memory holds one Arrow batch. Columns of the output's names are replaced.
    """

    @F.pandas_udf(T.LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([_counts(model_path).count_batch(part) for part in slices(texts.tolist())]))

    packed = df.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("whole"))
    counted = packed.select("row", F.octet_length("whole").cast("long").alias("n_bytes"), tokens("whole").alias("n_tokens"))
    return outputs_over("row", counted.withColumn("over_limit", F.col("n_tokens") > limit), ["n_bytes", "n_tokens", "over_limit"])
