"""Alias tables: draws in proportion to weights in constant time each."""

from __future__ import annotations

import numpy as np


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share, other): a cell is drawn evenly, and gives its own number with its share, else its other's."""
    w = np.asarray(weights, np.float64)
    share = w * len(w) / w.sum()
    other = np.arange(len(w))
    small, large = np.flatnonzero(share < 1).tolist(), np.flatnonzero(share >= 1).tolist()
    while small and large:
        s, g = small.pop(), large[-1]
        other[s] = g
        share[g] -= 1 - share[s]
        if share[g] < 1:
            small.append(large.pop())
    share[small + large] = 1  # what rounding left over
    return share, other


def draw(share: np.ndarray, other: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` numbers drawn from a table."""
    cell = rng.integers(0, len(share), n)
    return np.where(rng.random(n) < share[cell], cell, other[cell])
