"""Batches of texts as arrays: distinct chunks by number, and ragged rows laid end to end."""

from __future__ import annotations

import numpy as np


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def slices(texts: list[str], most: int = 1_500_000):
    """Runs of texts of about ``most`` characters together, which bounds what is held at once; a longer text is a run alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(text)
    yield texts[begin:]


def row_starts(lengths: np.ndarray) -> np.ndarray:
    """Where each of the rows laid end to end starts, and at last their total."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class PairTable:
    """Adjacent symbol pairs -> the merged symbol and its rank, looked up for whole arrays at once."""

    def __init__(self, left: list[int], right: list[int], merged: list[int], rank: list[float]):
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int64)[order], -1)
        self.ranks = np.append(np.array(rank, np.int64)[order], self.NONE)

    NONE = np.iinfo(np.int32).max

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` where the pair does not merge) and merged symbol; negative symbols never merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], self.NONE), np.where(hit, self.merged[at], -1)
