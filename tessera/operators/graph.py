"""Statistics and lookups on a nearest-neighbour graph ``edges(src, dst, dist, rank)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import keep

SCHEMA = "src long, dst long, dist double, rank int"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def nodes(edges: DataFrame) -> DataFrame:
    """(id) of every node, whether it has out-edges or is a neighbour only."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with dense numbers from 0 in ``order`` (which should tell all rows apart) as column ``name``.

    Numbers are given range by range: rows are range-partitioned and sorted, the
    counts of earlier ranges are added, so no task sees all rows.
    """
    by = [F.col("row")[c] for c in order]
    part = keep(rows.select(F.struct("*").alias("row")).repartitionByRange(*by).withColumn("p", F.spark_partition_id()))
    local = part.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(*by)))
    sizes = part.groupBy("p").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy(F.col("a.p").alias("p")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("base"))
    return local.join(F.broadcast(before), "p").select("row.*", (F.col("base") + F.col("r") - 1).alias(name))  # one row a partition


def node_index(ids: DataFrame) -> DataFrame:
    """(id, idx): dense numbers from 0 in order of id."""
    return numbered(ids.select("id").distinct(), ["id"], "idx")


def out_edges(edges: DataFrame, node: int) -> DataFrame:
    """Out-edges of a node in order; LookupError if it has none."""
    found = edges.where(F.col("src") == node).orderBy("rank")
    if found.isEmpty():
        raise LookupError(f"node {node} is not in the graph")
    return found


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbours): lists in order of rank, at most k long."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("neighbours"))


def size(edges: DataFrame) -> DataFrame:
    """One row (nb_nodes, nb_edges, max_nbng)."""
    n = nodes(edges).agg(F.count(F.lit(1)).alias("nb_nodes"))
    return edges.agg(F.count(F.lit(1)).alias("nb_edges"), F.max("rank").alias("max_nbng")).join(F.broadcast(n), how="cross").select("nb_nodes", "nb_edges", "max_nbng")


def node_ranges(edges: DataFrame) -> DataFrame:
    """(id, d_min, d_max): nearest and farthest neighbour distance."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.min("dist").alias("d_min"), F.max("dist").alias("d_max"))


def max_edge(edges: DataFrame) -> DataFrame:
    """(id, dist): the longest edge of each node."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("dist"))


def density_index(edges: DataFrame) -> DataFrame:
    """(id, density): one over the distance of the farthest neighbour."""
    return max_edge(edges).select("id", (1 / F.col("dist")).alias("density"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree), zeros included."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes(edges).join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """One row (mean_in_degree rounded, max_in_degree)."""
    return in_degrees(edges).agg(F.round(F.avg("degree")).cast("long").alias("mean_in_degree"), F.max("degree").alias("max_in_degree"))


def radius_at_quantile(edges: DataFrame, fraction: float) -> DataFrame:
    """One row (radius): quantile of the nearest distances; 0 for a fraction outside [0, 1]."""
    near = node_ranges(edges)
    if not 0 <= fraction <= 1:
        return near.agg(F.lit(0.0).alias("radius"))
    return near.agg(F.percentile("d_min", F.lit(fraction)).alias("radius"))


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement, the same for the same seed and rows."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *df.columns).limit(n)
