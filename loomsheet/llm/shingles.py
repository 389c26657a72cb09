"""Hashes of words and of word shingles, over whole blocks of texts in numpy.

Words are the runs between ASCII white space, with A-Z lowered. A word's hash is the sum of its
bytes, each times a 64-bit number for its place; a shingle's hash mixes those of its words. Equal
hashes stand for equal words and shingles: of 10^9 different shingles, two have the same 64 bits
with a probability of about 3 in 100.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same prefix for every n."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLD) + np.uint64(seed)) | np.uint64(1)


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a block of texts, and the n + 1 places where the words of each text begin."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] = solid[firsts]
    at = np.flatnonzero(begins)
    ends = np.searchsorted(at, offsets).astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), ends
    chars = (_LOWER[raw] if lower else raw)[solid]
    heads = np.flatnonzero(begins[solid])
    lengths = np.diff(np.append(heads, len(chars)))
    place = np.arange(len(chars), dtype=np.int32) - np.repeat(heads.astype(np.int32), lengths)
    values = (chars.astype(np.uint64) + np.uint64(1)) * series(int(lengths.max()), 17)[place]
    return mix(np.add.reduceat(values, heads)), ends


def shingles(hashes: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """The set of ``n``-word shingles of each text, as ascending 64-bit hashes; fewer words are one shingle together."""
    by = series(n, 99)
    total = len(hashes)
    if total >= n:
        rolled = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            rolled += hashes[j : total - n + 1 + j] * by[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(rolled[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(mix((hashes[a:b] * by[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
