"""Discrete probabilities and their entropies, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near_one(q: float) -> bool:
    return abs(q - 1.0) < 2.220446049250313e-16


def normalised(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``df`` with ``p``: the value over the sum of its group; an error on a negative value."""
    checked = F.when(F.col(value) < 0, F.raise_error(F.lit("a probability cannot be negative")).cast("double")).otherwise(F.col(value))
    return df.withColumn("p", checked / F.sum(value).over(Window.partitionBy(*by)))


def renyi(p: Column, q: float) -> Column:
    """Rényi entropy of order q of a group's probabilities; Shannon's at 1."""
    if near_one(q):
        return F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0))
    return F.log(F.sum(F.when(p > 0, F.pow(p, F.lit(float(q)))).otherwise(0.0))) / (1.0 - q)


def renyi_entropies(df: DataFrame, value: str, orders: list[float], *by: str) -> DataFrame:
    """One column ``h_<order>`` for each order."""
    return normalised(df, value, *by).groupBy(*by).agg(*[renyi(F.col("p"), q).alias(f"h_{q:g}".replace(".", "_")) for q in orders])


def relative_renyi(p: Column, other: Column, q: float) -> Column:
    """Sum of p ln(other / p) at order 1, else of p (other / p)^q."""
    if near_one(q):
        return F.sum(F.when((p > 0) & (other > 0), p * F.log(other / p)).otherwise(0.0))
    return F.sum(F.when(p > 0, p * F.pow(other / p, F.lit(float(q)))).otherwise(0.0))


def perplexity(w: Column) -> Column:
    """exp of the Shannon entropy of a neighbourhood's weights."""
    return F.exp(F.sum(F.when(w > 0, -w * F.log(w)).otherwise(0.0)))
