"""Keys shortened to five bytes and dealt to shards in packed form, for counting them with little to move."""

from __future__ import annotations

import numpy as np

#: Leading bits of a hash by which keys are counted; if keys clash, only more rows are looked at.
SHORT = 40


def short(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - SHORT)


def dealt(keys: np.ndarray, bits: int, *more: np.ndarray):
    """For each shard of sorted short keys: its number, its keys' lower bits as bytes, and the bytes of ``more``."""
    shard = (keys >> np.uint64(SHORT - bits)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    low = (keys & np.uint64((1 << (SHORT - bits)) - 1)).astype(np.uint32)
    cuts = [(int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [int(shard[a]) for a, _ in cuts], *[[x[a:b].tobytes() for a, b in cuts] for x in (low, *more)]


def shard_bits(keys: int) -> int:
    """Bits of the number of a shard, so that about two million keys come to a shard, and lower bits fit in four bytes."""
    return max(SHORT - 32, min(24, int(keys // 2_000_000).bit_length()))
