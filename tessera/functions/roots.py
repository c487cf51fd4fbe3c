"""Bisection for monotone functions, and the kernel width that it finds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOLERANCE = 1e-5
ROUNDS = 100


def bisect(f: Callable[[float], float], lower: float, upper: float, target: float, increasing: bool = True) -> float:
    """x in [lower, upper] with f(x) = target within 1e-5.

    ValueError if ``f`` is not monotone that way, the target is outside its
    range, or 100 halvings do not reach it.
    """
    sign = 1 if increasing else -1
    at_low, at_high = f(lower), f(upper)
    if sign * at_low > sign * at_high:
        raise ValueError("the function is not monotone in the direction given")
    if not sign * at_low <= sign * target <= sign * at_high:
        raise ValueError("the target is out of range")
    for _ in range(ROUNDS):
        middle = (lower + upper) / 2
        value = f(middle)
        if abs(value - target) < TOLERANCE:
            return middle
        if sign * value < sign * target:
            lower = middle
        else:
            upper = middle
    raise ValueError(f"not found; residual {abs(f(middle) - target)}")


def umap_scales(edges: DataFrame, norm: float) -> DataFrame:
    """(src, scale, weights): for each node the width with sum of exp(-(d - d0) / scale) = norm.

    All nodes of an Arrow batch are bisected at once.  A node whose sum cannot
    reach ``norm`` gets the nearest end of the bracket.
    """
    from pyspark.sql import functions as F

    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dist"))).alias("e")).select("src", F.col("e.dist").alias("d"))

    def run(batches):
        for t in batches:
            width = max((len(d) for d in t["d"]), default=0)
            d = np.full((len(t), width), np.inf)
            for i, row in enumerate(t["d"]):
                d[i, : len(row)] = np.asarray(row) - row[0]
            low, high = np.zeros(len(t)), np.full(len(t), 1e6)
            for _ in range(ROUNDS):
                beta = (low + high) / 2
                with np.errstate(invalid="ignore"):
                    total = np.where(np.isinf(d), 0.0, np.exp(-d * beta[:, None])).sum(1)
                low, high = np.where(total > norm, beta, low), np.where(total > norm, high, beta)
            weights = [np.exp(-(np.asarray(row) - row[0]) * b).tolist() for row, b in zip(t["d"], beta, strict=True)]
            yield pd.DataFrame({"src": t["src"], "scale": 1 / beta, "weights": weights})

    return lists.mapInPandas(run, "src long, scale double, weights array<double>")
