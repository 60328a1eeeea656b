"""Sets of word shingles as 64-bit hashes, for batches of texts or of their lines, on byte arrays."""

from __future__ import annotations

import numpy as np

from tidewater.llm.ragged import row_starts

_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z lower-cased, and every space one byte.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[_SPACE] = 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _SPREAD
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def inverse(odd: np.uint64) -> np.uint64:
    """The inverse of an odd number modulo 2^64, by Newton's rule."""
    x = odd
    with np.errstate(over="ignore"):
        for _ in range(6):
            x = x * (np.uint64(2) - odd * x)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, made anew for the longest array met."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 19) - 1, b, np.uint64)])) for b in (self.base, inverse(self.base)))
        return self.up, self.down


_POWERS = Powers(_BASE)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts end to end, and where each starts, with the total at last."""
    encoded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(encoded), np.uint8), row_starts(np.array([len(e) for e in encoded], np.int64))


def line_cuts(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of texts laid end to end: where each starts (and the total), its text, and its number there. A text has one line at least."""
    breaks = np.flatnonzero(data == 0x0A)
    lines = np.diff(np.searchsorted(breaks, cuts)) + 1
    first = row_starts(lines)
    starts = np.empty(first[-1] + 1, np.int64)
    heads = np.zeros(first[-1] + 1, bool)
    heads[first[:-1]] = True
    heads[-1] = True
    starts[first[:-1]] = cuts[:-1]
    starts[-1] = cuts[-1]
    starts[~heads] = breaks + 1
    owner = np.repeat(np.arange(len(lines)), lines)
    return starts, owner, np.arange(len(owner)) - first[:-1][owner]


def shingle_sets(data: np.ndarray, cuts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The size of each segment's set, and the sorted distinct hashes of its ``width``-word shingles, segment after segment.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Of fewer words the whole sequence is one
    shingle; of none the set is empty. A shingle's hash is the difference of two prefix sums over the
    bytes, in which any run of spaces is one, so that no word is handled by itself.
    """
    n = len(data)
    space = _SPACE[data]
    first = np.ones(n, bool)  # the byte before is a space or another segment's
    first[1:] = space[:-1]
    first[cuts[:-1][cuts[:-1] < n]] = True
    keep = ~(space & first)
    text = _FOLD[data[keep]]
    before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    cuts = before[cuts]
    space = text == 0x20
    begins = ~space
    begins[1:] &= space[:-1]
    heads = cuts[:-1][cuts[:-1] < len(text)]
    begins[heads] = ~space[heads]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(text))[: len(starts)]
    ends = ends - space[ends - 1]
    up, down = _POWERS.reach(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    words = np.diff(np.searchsorted(starts, cuts))
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(words)), shingles)
    at = np.arange(len(owner)) + (row_starts(words)[:-1] - row_starts(shingles)[:-1])[owner]
    begin, end = starts[at], ends[at + np.minimum(words, width)[owner] - 1]
    grams = mixed((sums[end] - sums[begin]) * down[begin])
    order = np.argsort(grams)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(words) <= 1 << 16 else np.int64), kind="stable")]
    grams = grams[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[: len(grams)]
    return np.bincount(owner[new], minlength=len(words)), grams[new]
