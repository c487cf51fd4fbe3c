"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that is reachable.

    Labels spread to neighbours and are then replaced by their own labels
    (pointer jumping), so rounds grow with the logarithm of a chain's length.
    Each round is written to the shared folder; minima are taken before the
    shuffle, so that a node with very many links is no hot spot.
    """
    e = links.where("a <> b").select("a", "b")
    e = materialise(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = e.join(labels, e.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        step = step.join(over, step.label == over.via).select("node", "old", F.least("label", "jump").alias("label"))
        step = materialise(step, "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
