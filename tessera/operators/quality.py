"""How well an embedding keeps the neighbourhoods of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2
from .graph import max_edge
from .knn import knn


def transformed_edges(edges: DataFrame, coords: DataFrame, running_min: bool = False) -> DataFrame:
    """(src, dst, rank, length): embedded length of each edge; with ``running_min`` the least up to its rank."""
    x = coords.select(F.col("id").alias("src"), F.col("coords").alias("x"))
    y = coords.select(F.col("id").alias("dst"), F.col("coords").alias("y"))
    out = edges.join(x, "src").join(y, "dst").select("src", "dst", "rank", l2(F.col("x"), F.col("y")).alias("length"))
    if running_min:
        out = out.withColumn("length", F.min("length").over(Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return out


def embedded_radius(coords: DataFrame, nbng: int, **how) -> DataFrame:
    """(id, dist): distance of each embedded point to its ``nbng``-th embedded neighbour."""
    return max_edge(knn(coords.select("id", F.col("coords").alias("v")), nbng, "l2", **how))


def continuity(edges: DataFrame, coords: DataFrame, nbng: int, running_min: bool = False, **how) -> DataFrame:
    """(src, dst, rank, length, radius, ratio) of every edge."""
    r = embedded_radius(coords, nbng, **how).select(F.col("id").alias("src"), F.col("dist").alias("radius"))
    return transformed_edges(edges, coords, running_min).join(r, "src").withColumn("ratio", F.col("length") / F.col("radius"))


def first_dist(edges: DataFrame, coords: DataFrame, running_min: bool = False) -> DataFrame:
    """(id, dist): embedded distance to the first neighbour that the edges lead to."""
    return transformed_edges(edges, coords, running_min).groupBy(F.col("src").alias("id")).agg(F.min("length").alias("dist"))


def summary(edges: DataFrame, coords: DataFrame, nbng: int = 100, running_min: bool = False, **how) -> DataFrame:
    """One row: nodes without a match, mean matches of the others, quantiles and mean of the ratios, median radius."""
    c = continuity(edges, coords, nbng, running_min, **how)
    nodes = c.groupBy("src").agg(F.sum((F.col("length") <= F.col("radius")).cast("int")).alias("m"), F.first("radius").alias("radius"))
    a = nodes.agg(F.sum((F.col("m") == 0).cast("int")).alias("nb_without_match"), F.avg(F.when(F.col("m") > 0, F.col("m"))).alias("mean_matches"), F.percentile("radius", F.lit(0.5)).alias("median_radius"))
    q = [0.05, 0.25, 0.5, 0.75, 0.85, 0.95]
    b = c.agg(F.percentile("ratio", F.array(*map(F.lit, q))).alias("ratio_quantiles"), F.avg("ratio").alias("mean_ratio"))
    return a.join(F.broadcast(b), how="cross")
