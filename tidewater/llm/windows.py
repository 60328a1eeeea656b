"""Hashes of all substrings of one length, and the positions that a content-defined cover samples, for batches of texts."""

from __future__ import annotations

import numpy as np

from tidewater.llm.shingles import Powers, mixed

_POWERS = tuple(Powers(np.uint64(base)) for base in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5))


class Rolling:
    """Hashes of substrings of a byte array by differences of prefix sums of powers modulo 2^64."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _POWERS[which].reach(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hashes of data[start:end], whose lengths count too."""
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(value ^ (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def all_of(self, width: int) -> np.ndarray:
        """The hashes of all substrings of one length in order."""
        if len(self.sums) <= width:
            return np.zeros(0, np.uint64)
        value = (self.sums[width:] - self.sums[: len(self.sums) - width]) * self.down[: len(self.sums) - width]
        return mixed(value ^ np.uint64(width) * np.uint64(0x9E3779B97F4A7C15))


def cover(names: np.ndarray, ends: np.ndarray, total: int, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, windows) of sampled positions of ``total`` bytes that are cut at ``ends``; ``names`` are the hashes of their grams.

    Every ``width``-byte window that lies within one text samples the ``gram``-byte substring in it with
    the smallest hash, the leftmost of equals. Equal windows thus sample at equal offsets, which is what a
    difference cover gives, with 2 / (width - gram + 2) of all positions instead of two thirds. Windows
    that sample one position are neighbours.
    """
    windows = total - width + 1
    empty = np.zeros(0, np.int64)
    if windows <= 0:
        return empty, empty, empty
    low = np.uint64((1 << max(28, total.bit_length())) - 1)
    least = names & ~low | np.arange(len(names), dtype=np.uint64)
    span, need = 1, width - gram + 1
    while span * 2 <= need:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < need:
        least = np.minimum(least[: len(least) - (need - span)], least[need - span :])
    sampled = (least[:windows] & low).astype(np.int64)
    inside = np.ones(windows + width, bool)
    for end in ends[:-1].tolist():  # windows across a cut
        inside[max(0, end - width + 1) : end] = False
    inside = np.flatnonzero(inside[:windows])
    sampled = sampled[inside]
    if not len(inside):
        return empty, empty, empty
    new = np.append(True, (sampled[1:] != sampled[:-1]) | (inside[1:] != inside[:-1] + 1))
    first = np.flatnonzero(new)
    return sampled[first], inside[first], np.diff(np.append(first, len(inside)))
