"""Vectorised hashes of words and of word shingles, over the UTF-8 bytes of a whole text."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_powers = np.ones(1, np.uint64)

#: bytes between words: space and U+0009 to U+000D
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(9, 14)]] = True
#: bytes in words when punctuation doesn't count: letters, digits and all beyond ASCII
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        top = _powers[-1:] * _A
        _powers = np.concatenate((_powers, top * _powers))
    return _powers


def words(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each maximal run of bytes that are `inside`; A-Z count as a-z."""
    b = _lower[np.frombuffer(data, np.uint8)]
    flags = np.concatenate(([False], inside[b], [False]))
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    size = end - start
    take = np.flatnonzero(flags[1:-1])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    within = np.arange(len(take)) - np.repeat(first, size)
    h = np.add.reduceat((b[take].astype(np.uint64) + np.uint64(1)) * _power(int(size.max()))[within], first)
    return mix(h + size.astype(np.uint64) * _A), start, end


def shingles(word: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; of fewer words, the one run of them all."""
    if not len(word):
        return np.empty(0, np.uint64)
    n = min(size, len(word))
    out = np.zeros(len(word) - n + 1, np.uint64)
    for j in range(n):
        out += word[j : len(word) - n + 1 + j] * _power(size)[j]
    return mix(out + np.uint64(n))
