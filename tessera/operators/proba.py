"""Edge probabilities of a nearest-neighbour graph, by windows over each neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entropy import perplexity

FLOOR = 1e-4


def proba_edges(edges: DataFrame, scale_rho: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(src, dst, w, scale): kernel weights that sum to 1 over each neighbourhood.

    The width is ``scale_rho`` times the mean of the nearest distances of the
    node and its neighbours.  Where all distances are equal or 0 weights are even.
    """
    first = edges.where("rank = 1").select(F.col("src").alias("n"), F.col("dist").alias("d1"))
    near = edges.join(first.withColumnRenamed("d1", "nd1"), edges.dst == F.col("n"), "left").drop("n")
    by = Window.partitionBy("src")
    near = near.withColumn("d0", F.min("dist").over(by)).withColumn("top", F.max("dist").over(by)).withColumn("k", F.count(F.lit(1)).over(by))
    rho = (F.sum(F.coalesce("nd1", F.lit(0.0))).over(by) + F.col("d0")) / (F.col("k") + 1)
    near = near.withColumn("scale", rho * scale_rho)
    raw = F.greatest(F.exp(-F.pow(F.greatest(F.col("dist") - F.col("d0"), F.lit(0.0)) / F.col("scale"), F.lit(float(beta)))), F.lit(FLOOR))
    even = (F.col("top") <= F.col("d0")) | (F.col("top") <= 0) | (F.col("scale") <= 0)
    near = near.withColumn("raw", F.when(even, F.lit(1.0)).otherwise(raw))
    return near.select("src", "dst", (F.col("raw") / F.sum("raw").over(by)).alias("w"), "scale")


def scales(kernel: DataFrame) -> DataFrame:
    """(id, scale) of a kernel."""
    return kernel.groupBy(F.col("src").alias("id")).agg(F.first("scale").alias("scale"))


def perplexities(kernel: DataFrame) -> DataFrame:
    return kernel.groupBy(F.col("src").alias("id")).agg(perplexity(F.col("w")).alias("perplexity"))


def symmetric(kernel: DataFrame) -> DataFrame:
    """(src, dst, w): half the sum of the kernel and its transpose."""
    half = kernel.select("src", "dst", (F.col("w") / 2).alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def legacy_laplacian(kernel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, dst, w), (id, norm)): degree-normalised symmetric kernel, and the degrees."""
    g = symmetric(kernel)
    deg = g.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("norm"))
    a = deg.select(F.col("id").alias("src"), F.col("norm").alias("ni"))
    b = deg.select(F.col("id").alias("dst"), F.col("norm").alias("nj"))
    return g.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ni") * F.col("nj"))).alias("w")), deg
