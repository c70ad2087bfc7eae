"""Words, word hashes and word n-gram hashes of many texts at once, on bytes with numpy.

A word is a run of bytes other than space and 0x09-0x0D, the same as `[^\\x20\\x09-\\x0D]+` on the
text, since these bytes never occur inside a UTF-8 sequence. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def random64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, n, dtype=np.uint64) | np.uint64(1)


_BYTE, _BYTE2 = random64(11, 256), random64(13, 256)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xBF58476D1CE4E5B9
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = 0xD1342543DE82EF95
_GRAM_INV = pow(_GRAM, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of a run of texts: byte range of each, hash of each, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        self.data = data = LOWER[data] if lower else data
        self.offsets, self.space = offsets, space
        inside = ~space[data] if len(data) else np.zeros(0, bool)
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        before[cuts], after[cuts - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # n+1: words of text i are first[i]:first[i+1]

    @property
    def n(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self, second: bool = False) -> np.ndarray:
        """The hash of each word; `second`: one by another table and base."""
        if not self.n:
            return np.zeros(0, np.uint64)
        lo = int(self.starts[0])
        spans = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(len(self.data) - lo, dtype=np.int32) - np.repeat((self.starts - lo).astype(np.int32), spans)
        values = np.where(self.space, np.uint64(0), _BYTE2 if second else _BYTE)[self.data[lo:]]
        values *= powers(_BASE2 if second else _BASE, int(spans.max()))[place]
        return mix(np.add.reduceat(values, self.starts - lo))

    @staticmethod
    def grams(hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each word on; it is of use only where whole() is true."""
        if len(hashes) < n:
            return np.zeros(len(hashes), np.uint64)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_GRAM, len(hashes)), out=sums[1:])
        out = np.zeros(len(hashes), np.uint64)
        m = len(hashes) - n + 1
        out[:m] = mix((sums[n:] - sums[:m]) * powers(_GRAM_INV, m) + np.uint64(n))
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether n words from each word on lie in its text."""
        at = np.arange(self.n)
        return at + n <= np.repeat(self.first[1:], self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()
