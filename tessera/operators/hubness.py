"""Hubness: how often a point is among the neighbours of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import in_degrees

#: The ranks at which the distribution is reported.
THRESHOLDS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999]


def hubness(edges: DataFrame) -> DataFrame:
    """(id, hubness), zeros included."""
    return in_degrees(edges).withColumnRenamed("degree", "hubness")


def standard_third_moment(counts: DataFrame) -> DataFrame:
    """One row (skew): third central moment over the cube of the sample deviation; 0 for one node."""
    n = F.count(F.lit(1))
    skew = F.skewness("hubness") * F.pow((n - 1) / n, F.lit(1.5))
    return counts.agg(F.when((n <= 1) | skew.isNull() | F.isnan(skew), 0.0).otherwise(skew).alias("skew"))


def histogram(counts: DataFrame) -> DataFrame:
    """(low, nb): counts in buckets of one significant digit, from 1 to twice the root of the number of nodes; the rest as low -1."""
    n = counts.agg((2 * F.floor(F.sqrt(F.count(F.lit(1))))).alias("most"))
    digit = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest("hubness", F.lit(1)))))
    low = F.when((F.col("hubness") < 1) | (F.col("hubness") > F.col("most")), F.lit(-1)).otherwise((F.floor(F.col("hubness") / digit) * digit).cast("long"))
    return counts.join(F.broadcast(n), how="cross").groupBy(low.cast("long").alias("low")).agg(F.count(F.lit(1)).alias("nb"))


def quantiles(counts: DataFrame, fractions: list[float] = THRESHOLDS) -> DataFrame:
    """(fraction, hubness): exact quantiles."""
    q = counts.agg(F.percentile("hubness", F.array(*map(F.lit, fractions))).alias("q"))
    return q.select(F.posexplode("q").alias("k", "hubness")).select(F.element_at(F.array(*map(F.lit, fractions)), F.col("k") + 1).alias("fraction"), "hubness")


def top_hubs(edges: DataFrame, n: int = 20) -> DataFrame:
    """(id, hubness) of the n largest hubs, ties to the smaller id."""
    return hubness(edges).orderBy(F.desc("hubness"), "id").limit(n)


def hubness_of(edges: DataFrame, node: int) -> DataFrame:
    return hubness(edges).where(F.col("id") == node)
