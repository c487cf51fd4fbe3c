"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

MULT = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    global POWERS
    if len(POWERS) < n:
        p = np.full(2 * n, MULT)
        p[0] = 1
        POWERS = np.multiply.accumulate(p)
    return POWERS[:n]


POWERS = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = np.asarray(h, np.uint64)
    h = np.multiply(h ^ (h >> np.uint64(31)), MIX)
    return h ^ (h >> np.uint64(29))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words of each text); A-Z lower-cased, words parted by space and 0x09 to 0x0D."""
    joined = b"\n".join(texts) + b"\n"
    data = LOWER[np.frombuffer(joined, np.uint8)]
    inside = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.r_[0, edge]
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    size = end - begin
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    offset = at - np.repeat(begin, size)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[offset]
    h = mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64) * MIX)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.bincount(np.searchsorted(ends, begin, "right"), minlength=len(texts))


def sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``size`` words.

    A text with fewer words is one shingle, one without words has none.
    """
    h, n = words(texts)
    if not len(h):
        return [np.zeros(0, np.uint64) for _ in texts]
    grams = np.zeros(len(h), np.uint64)
    for k in range(min(size, len(h))):
        grams[: len(h) - k] = grams[: len(h) - k] * MULT + h[k:]
    grams = mix(grams)
    out, at = [], 0
    for m in n.tolist():
        if m >= size:
            g = np.sort(grams[at : at + m - size + 1])
            out.append(g[np.r_[True, g[1:] != g[:-1]]])
        elif m:
            out.append(mix(np.bitwise_xor.reduce(h[at : at + m] * _powers(m + 2)[1 : m + 1]) + np.array([m], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out
