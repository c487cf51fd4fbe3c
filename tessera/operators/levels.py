"""Sampling levels, graphs on the upper levels, and projection onto them."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn import knn, top_k


def level(id_: Column, m: int, scale: float = 1.0, most: int = 15) -> Column:
    """Level of an id: exponential with mean scale / ln(m), from an arithmetic hash of the id."""
    u = (F.pmod(id_ * F.lit(2654435761), F.lit(4294967296)) + 1) / F.lit(4294967297.0)
    return F.least(F.floor(-F.log(u) * scale / log(m)), F.lit(most)).cast("int")


def levels(points: DataFrame, m: int = 64, scale: float = 1.0, most: int = 15) -> DataFrame:
    return points.select("id", level(F.col("id"), m, scale, most).alias("level"))


def layer_knn(points: DataFrame, lv: DataFrame, layer: int, k: int = 10, metric: str = "l2", **how) -> DataFrame:
    """The graph of the points at ``layer`` or above, among themselves."""
    return knn(points.join(lv.where(F.col("level") >= layer).select("id"), "id", "left_semi"), k, metric, **how)


def project(points: DataFrame, lv: DataFrame, layer: int, metric: str = "l2", **how) -> DataFrame:
    """(id, upper_id, dist): the nearest point at ``layer`` or above; upper points are their own, at 0."""
    high = lv.where(F.col("level") >= layer).select("id")
    low = lv.where(F.col("level") < layer).select("id")
    near = knn(points.join(high, "id", "left_semi"), 1, metric, queries=points.join(low, "id", "left_semi"), **how)
    own = high.select("id", F.col("id").alias("upper_id"), F.lit(0.0).alias("dist"))
    return near.select(F.col("src").alias("id"), F.col("dst").alias("upper_id"), "dist").unionByName(own)


def project_by_edges(edges: DataFrame, lv: DataFrame, layer: int) -> DataFrame:
    """Projection along the graph alone: the nearest neighbour at ``layer`` or above; lower points without one are missing."""
    high = lv.where(F.col("level") >= layer).select(F.col("id").alias("dst"))
    low = lv.where(F.col("level") < layer).select(F.col("id").alias("src"))
    hit = edges.join(high, "dst", "left_semi").join(low, "src", "left_semi")
    near = top_k(hit.select("src", "dst", "dist"), 1).select(F.col("src").alias("id"), F.col("dst").alias("upper_id"), "dist")
    return near.unionByName(high.select(F.col("dst").alias("id"), F.col("dst").alias("upper_id"), F.lit(0.0).alias("dist")))


def fix(proj: DataFrame, edges: DataFrame, lv: DataFrame) -> DataFrame:
    """``proj`` and, for points that it lacks, the projection of their first neighbour that has one (one round)."""
    lost = lv.select("id").join(proj, "id", "left_anti")
    via = edges.join(lost, edges.src == lost.id, "left_semi").join(proj.withColumnRenamed("dist", "pdist"), F.col("dst") == F.col("id"))
    first = via.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("rank"))).where("r = 1")
    return proj.unionByName(first.select(F.col("src").alias("id"), "upper_id", F.col("pdist").alias("dist")))


def fix_all(proj: DataFrame, edges: DataFrame, lv: DataFrame, rounds: int = 3) -> DataFrame:
    for _ in range(rounds):
        proj = fix(proj, edges, lv)
    return proj


def projection_quantiles(proj: DataFrame, fractions: list[float]) -> DataFrame:
    """One row (quantiles) of the projection distances, zeros of upper points included."""
    return proj.agg(F.percentile("dist", F.array(*map(F.lit, fractions))).alias("quantiles"))
