"""Intrinsic dimension of the data behind a nearest-neighbour graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import numbered, sample


def by_node(edges: DataFrame) -> DataFrame:
    """(id, dim): maximum-likelihood estimate at each point, averaged over ranks.

    With at least 20 neighbours the ranks are 8 to 19 (from 0), with more than 3
    all from 2 on; points with fewer, or without a positive estimate, are left out.
    """
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dist"))), lambda e: e["dist"]).alias("t"))
    n = F.size("t")
    first, last = F.when(n >= 20, 8).otherwise(2), F.when(n >= 20, 19).otherwise(n - 1)

    def at(k):
        logs = F.transform(F.sequence(F.lit(1), k - 1), lambda j: F.log(F.get("t", k) / F.get("t", j)))
        return (k - 1) / F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)

    found = lists.where(n > 3).select("id", F.filter(F.transform(F.sequence(first, last), at), lambda d: d.isNotNull() & (d > 0) & (d < float("inf"))).alias("d"))
    return found.where(F.size("d") > 0).select("id", (F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")).alias("dim"))


def estimate(edges: DataFrame, sampling: int | None = 10_000, seed: int = 4664397) -> DataFrame:
    """One row (dim, std, nb): mean and population deviation over sampled nodes, or all with ``sampling`` None."""
    d = by_node(edges)
    if sampling is not None:
        d = sample(d, sampling, seed)
    return d.agg(F.avg("dim").alias("dim"), F.stddev_pop("dim").alias("std"), F.count(F.lit(1)).alias("nb"))


def two_nn(edges: DataFrame, sampling: int | None = None, seed: int = 4664397) -> DataFrame:
    """One row (dim): slope of -ln(1 - F) over ln(r), r the ratio of the two nearest distances.

    The rank of each ratio is needed among all; ranges of ratios are sorted apart.
    """
    two = edges.where("rank <= 2").groupBy("src").agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("d2"))
    r = two.where("d1 > 0 and d2 is not null").select("src", (F.col("d2") / F.col("d1")).alias("r"))
    if sampling is not None:
        r = sample(r, sampling, seed)
    n = r.agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(r, ["r", "src"], "k").join(F.broadcast(n), how="cross")
    x, y = F.log("r"), -F.log(1 - F.col("k") / F.col("n"))
    return ranked.agg((F.sum(x * y) / F.sum(x * x)).alias("dim"))
