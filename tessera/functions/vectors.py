"""Distances and small vector functions as columns, over ARRAY<DOUBLE>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-30  # inside logarithms


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm_l2(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm_l2(a) * norm_l2(b))


def _ln(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(TINY)))


def jeffreys(a: Column, b: Column) -> Column:
    """Of probability vectors: sum of (x - y) ln(x / y)."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (_ln(x) - _ln(y))))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Of probability vectors: root of the mean divergence from their mean."""
    part = F.zip_with(a, b, lambda x, y: (x * (_ln(x) - _ln((x + y) / 2)) + y * (_ln(y) - _ln((x + y) / 2))) / 2)
    return F.sqrt(F.greatest(_sum(part), F.lit(0.0)))


#: Public names of the distances.
METRICS = {"DistL1": "l1", "DistL2": "l2", "DistCosine": "cosine", "DistJeffreys": "jeffreys", "DistJensenShannon": "jensen_shannon"}
COLUMNS = {"l1": l1, "l2": l2, "cosine": cosine, "jeffreys": jeffreys, "jensen_shannon": jensen_shannon}


def metric_name(name: str) -> str:
    """The short name of a distance; ValueError if it is unknown."""
    short = METRICS.get(name, name)
    if short not in COLUMNS:
        raise ValueError(f"unknown distance {name!r}; known are {', '.join(METRICS)}")
    return short


def distance(metric: str, a: Column, b: Column) -> Column:
    return COLUMNS[metric_name(metric)](a, b)


def unrolled(metric: str, a: list[Column], b: list[Column]) -> Column:
    """``distance`` of vectors whose coordinates are columns, added in the same order; unlike lambdas over arrays it is compiled."""
    total = lambda parts: reduce(lambda s, x: s + x, parts, F.lit(0.0))
    ends = list(zip(a, b, strict=True))
    metric = metric_name(metric)
    if metric == "l1":
        return total(F.abs(x - y) for x, y in ends)
    if metric == "l2":
        return F.sqrt(total((x - y) * (x - y) for x, y in ends))
    if metric == "cosine":
        return F.lit(1.0) - total(x * y for x, y in ends) / (F.sqrt(total(x * x for x in a)) * F.sqrt(total(y * y for y in b)))
    if metric == "jeffreys":
        return total((x - y) * (_ln(x) - _ln(y)) for x, y in ends)
    return F.sqrt(F.greatest(total((x * (_ln(x) - _ln((x + y) / 2)) + y * (_ln(y) - _ln((x + y) / 2))) / 2 for x, y in ends), F.lit(0.0)))


def clip(x: Column, most: float) -> Column:
    """Clamp to plus or minus ``most``."""
    return F.greatest(F.least(x, F.lit(float(most))), F.lit(-float(most)))


def cauchy_weight(squared: Column, scale: Column, b: float = 1.0) -> Column:
    """Edge weight 1 / (1 + (d^2 / s^2)^b) in the embedded space, under 1."""
    return F.least(1 / (1 + F.pow(squared / (scale * scale), F.lit(float(b)))), F.lit(1 - 2.220446049250313e-16))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def probability(v: Column) -> Column:
    """|v| over its sum: a probability vector."""
    total = _sum(F.transform(v, F.abs))
    return F.transform(v, lambda x: F.abs(x) / total)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
