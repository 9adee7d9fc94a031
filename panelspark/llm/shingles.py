"""Word shingles of whole texts as sorted arrays of 64-bit hashes, in NumPy.

A word is a run of bytes outside space and \\x09-\\x0D after lower-casing A-Z. A text of
fewer than ``width`` words has its whole word sequence as its one shingle; a text without
words has none. Two different shingles share a hash with probability 2**-64 each.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.array([[0xBF58476D1CE4E5B9, 0x94D049BB133111EB]], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _GAP[0, 0]
    x = (x ^ (x >> np.uint64(27))) * _GAP[0, 1]
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse)], dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a text's bytes."""
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[raw], True]))
    return edge[::2], edge[1::2]


def range_hashes(codes: np.ndarray):
    """A function of (start, end) arrays that hashes these ranges of a sequence of 64-bit codes, however long, in constant time each."""
    up, down = _powers.to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * up[: len(codes)], out=sums[1:])

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    return of


def byte_hashes(raw: np.ndarray):
    """``range_hashes`` of bytes."""
    return range_hashes(_BYTE[raw])


def word_hashes(text: str) -> np.ndarray:
    """One hash per word, in order."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    return byte_hashes(raw)(*word_places(raw))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (null or wordless: empty)."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    span = min(width, len(words))
    out = np.zeros(len(words) - span + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            out = out * _BASE + words[k : len(words) - span + 1 + k]
        if len(words) < width:
            out = mix(out + np.uint64(len(words)))
        return np.unique(mix(out))
