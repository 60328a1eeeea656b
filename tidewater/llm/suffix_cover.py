"""Bounded suffix sorting by a difference cover: sampled triples, names of names, and merges at common offsets."""

from __future__ import annotations

import numpy as np


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of records, the first key weighing most."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(new)
    return out


def _words(data: np.ndarray, length: int, count: int) -> np.ndarray:
    """The big-endian numbers of ``length`` (8 at most) bytes from each of the first ``count`` positions."""
    out = np.zeros(count, np.uint64)
    for k in range(length):
        out = out << np.uint64(8) | data[k : k + count]
    return out


def sample_names(data: np.ndarray, count: int, depth: int) -> np.ndarray:
    """Order-keeping names of the ``depth`` bytes from each sampled position, those that 3 does not divide, below ``count``.

    ``data`` holds ``depth`` bytes and more behind them. The sampled triples of words are sorted and named;
    then triples of names, each as far from the next as it is long, until the next would be too long. All
    of these positions are sampled, as the lengths are multiples of three. A last round adds the bytes
    that are missing: names that overlap, and at most two single bytes.
    """
    word = min(8, depth // 3)
    words = _words(data, word, count + 2 * word)
    at = np.arange(count)
    at = at[at % 3 != 0]
    names = np.zeros(len(data) + 2 * depth, np.uint64)
    names[at] = _ranks(words[at], words[at + word], words[at + 2 * word])
    length = 3 * word
    while 3 * length <= depth:
        names[at] = _ranks(names[at] << np.uint64(32) | names[at + length], names[at + 2 * length])
        length *= 3
    if length < depth:
        step = (depth - length) // 3 * 3
        pairs = names[at] << np.uint64(32) | (names[at + length] if step > length else names[at + step])
        rest = names[at + step] << np.uint64(16) if step > length else np.zeros(len(at), np.uint64)
        for k in range(step + length, depth):
            rest |= data[at + k].astype(np.uint64) << np.uint64(8 * (depth - 1 - k))
        names[at] = _ranks(pairs, rest)
    return names


def same_bytes(data: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` bytes from each begin equal those from the one before."""
    views = np.lib.stride_tricks.sliding_window_view(data, width)
    same = np.zeros(len(begin), bool)
    for k in range(1, len(begin), 50_000):
        rows = views[begin[k - 1 : k + 50_000]]
        same[k : k + 50_000] = (rows[1:] == rows[:-1]).all(axis=1)
    return same


def least_owner(data: np.ndarray, begin: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For each ``width``-byte window of ``data`` at ``begin``, the least owner of any window of the same bytes.

    A window's rank is that of the sampled position at an offset of 0, 1 or 2, with the bytes before and
    after it; any two windows have an offset at which both are sampled. So the windows are merged three
    times, those of two remainders of three each time, and neighbours whose bytes are equal share their
    least owner.
    """
    least = owner.copy()
    padded = np.concatenate([data, np.zeros(width + 24, np.uint8)])

    def share(which: np.ndarray, key: np.ndarray) -> None:
        if not len(which):
            return
        order = np.argsort(key)
        rows, key = which[order], key[order]
        alike = np.append(False, key[1:] == key[:-1])
        near = np.flatnonzero(alike | np.append(alike[1:], False))
        alike[near] &= same_bytes(data, begin[rows[near]], width)
        first = np.flatnonzero(~alike)
        least[rows] = np.minimum(least[rows], np.minimum.reduceat(owner[rows], first)[np.cumsum(~alike) - 1])

    if width <= 8:
        share(np.arange(len(begin)), _words(padded, width, len(data))[begin])
        return least
    names = sample_names(padded, len(data), width - 2)
    byte = lambda at, shift: padded[at].astype(np.uint64) << np.uint64(shift)
    for offset in range(3):
        which = np.flatnonzero((begin + offset) % 3 != 0)
        at = begin[which]
        name = names[at + offset]
        if offset == 0:
            key = name << np.uint64(16) | byte(at + width - 2, 8) | byte(at + width - 1, 0)
        elif offset == 1:
            key = byte(at, 48) | name << np.uint64(8) | byte(at + width - 1, 0)
        else:
            key = byte(at, 56) | byte(at + 1, 48) | name
        share(which, key)
    return least
