"""Minimum spanning forests and single-linkage clusters of a graph."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import dropped, keep, stored


class UnionFind:
    """Disjoint sets of any hashable nodes, with path halving and union by rank."""

    def __init__(self, parents: dict | None = None):
        self.parents = dict(parents or {})
        self.ranks: dict = {}

    def find(self, node):
        self.parents.setdefault(node, node)
        while self.parents[node] != node:
            above = self.parents[self.parents[node]]
            self.parents[node] = above
            node = above
        return node

    def union(self, a, b) -> bool:
        """Join two sets; False if they are one."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        ra, rb = self.ranks.get(a, 0), self.ranks.get(b, 0)
        low, high = (a, b) if ra < rb else (b, a)
        self.parents[low] = high
        self.ranks[high] = max(ra, rb) + (ra == rb)
        return True


def kruskal(edges: Iterable[tuple]) -> Iterator[tuple]:
    """Edges (a, b, w) of a minimum spanning forest, lightest first; nan counts as heaviest."""
    sets = UnionFind()
    for a, b, w in sorted(edges, key=lambda e: (e[2] != e[2], e[2], e[0], e[1])):
        if sets.union(a, b):
            yield a, b, w


def _kept(df: DataFrame) -> DataFrame:
    """A table of a round.  Read back from files, it brings no constraints of the rounds before, which would double with each."""
    return stored(df, "trees")


#: Edges up to which trees are built on the driver: none, unless a caller who knows that a graph is small asks for it.
DRIVER = 0


def spanning_forest(edges: DataFrame, driver: int = DRIVER) -> DataFrame:
    """(a, b, w): minimum spanning forest of ``edges`` (src, dst, dist), by rounds of lightest edges.

    In each round every component takes its lightest edge out (ties by the ends),
    components that meet are merged by pointer jumping; rounds are logarithmic in
    the number of nodes.  Only up to ``driver`` edges are taken to the driver.
    """
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("dist").alias("w")).where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w"))
    e = keep(e)
    if driver and e.count() <= driver:
        return edges.sparkSession.createDataFrame(list(kruskal(map(tuple, e.collect()))), "a long, b long, w double")
    e = _kept(e.withColumn("ca", F.col("a")).withColumn("cb", F.col("b")))
    forest = None
    while True:
        out = e.select(F.col("ca").alias("c"), F.col("cb").alias("d"), "w", "a", "b").unionByName(e.select(F.col("cb").alias("c"), F.col("ca").alias("d"), "w", "a", "b"))
        best = _kept(out.groupBy("c").agg(F.min(F.struct("w", "a", "b", "d")).alias("m")).select("c", "m.*"))
        if best.isEmpty():
            return forest if forest is not None else e.select("a", "b", "w")
        chosen = best.select("a", "b", "w").distinct()
        forest = _kept(chosen if forest is None else forest.unionByName(chosen))
        up = best.select("c", F.col("d").alias("up"))
        back = up.select(F.col("c").alias("up"), F.col("up").alias("back"))
        up = _kept(up.join(back, "up", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up")))
        while True:  # pointer jumping to the roots
            over = up.select(F.col("c").alias("up"), F.col("up").alias("next"))
            jumped = _kept(up.join(over, "up").select("c", F.col("next").alias("new"), (F.col("next") != F.col("up")).alias("moved")))
            up = jumped.select("c", F.col("new").alias("up"))
            if jumped.where("moved").isEmpty():
                break
        a, b = up.select(F.col("c").alias("ca"), F.col("up").alias("ra")), up.select(F.col("c").alias("cb"), F.col("up").alias("rb"))
        e = _kept(e.join(a, "ca").join(b, "cb").where("ra <> rb").groupBy(F.col("ra").alias("ca"), F.col("rb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("m")).select("m.a", "m.b", "m.w", "ca", "cb"))


def labels(nodes: DataFrame, links: DataFrame, driver: int = DRIVER) -> DataFrame:
    """(id, cluster): smallest id that the links (a, b) reach; on the driver while there are at most ``driver`` nodes and links."""
    links = _kept(links.select("a", "b"))
    if driver and links.count() <= driver and nodes.count() <= driver:
        sets, least = UnionFind(), {}
        for r in links.collect():
            sets.union(r["a"], r["b"])
        ids = sorted(r["id"] for r in nodes.select("id").collect())
        for i in ids:
            least.setdefault(sets.find(i), i)
        return nodes.sparkSession.createDataFrame([(i, least[sets.find(i)]) for i in ids], "id long, cluster long")
    both = _kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = _kept(nodes.select("id", F.col("id").alias("cluster")))
    while True:
        near = both.join(lab, both.b == lab.id).groupBy("a").agg(F.min("cluster").alias("near"))
        new = lab.join(near, lab.id == near.a, "left").select("id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"))
        over = lab.select(F.col("id").alias("cluster"), F.col("cluster").alias("jump"))
        last, new = lab, _kept(new.join(over, "cluster").select("id", "old", F.least("cluster", "jump").alias("cluster")))
        lab = new.select("id", "cluster")
        dropped(last)
        lab._stored_at = new._stored_at
        if new.where("old <> cluster").isEmpty():
            return lab


def single_linkage(edges: DataFrame, nb_clusters: int) -> DataFrame:
    """(id, cluster): the spanning forest without its heaviest edges, so that ``nb_clusters`` remain (or the forest's trees, if more)."""
    from .graph import nodes, numbered

    ids = nodes(edges)
    forest = keep(spanning_forest(edges))
    n = ids.count()
    links = max(0, min(forest.count(), n - nb_clusters))
    return labels(ids, numbered(forest, ["w", "a", "b"], "step").where(F.col("step") < links).drop("step"))


def dendrogram(edges: DataFrame) -> DataFrame:
    """(step, a, b, w): merges of single linkage, lightest first."""
    from .graph import numbered

    return numbered(spanning_forest(edges), ["w", "a", "b"], "step").select((F.col("step") + 1).alias("step"), "a", "b", "w")


MERGE = "step long, a long, b long, w double, cluster_a long, cluster_b long, size_a long, size_b long, density_a double, density_b double"


def merge_tree(edges: DataFrame, most: int = 4096) -> DataFrame:
    """The merges of single linkage, lightest first, with the two clusters that each joins.

    (step, a, b, w, cluster_a, cluster_b, size_a, size_b, density_a, density_b):
    a cluster is named by its smallest id; its density is the mean over its nodes
    of the mean distance of their neighbours (0 for nodes without any).

    Steps are cut in halves until a range has at most ``most`` of them.  In a round
    all ranges are cut at once: edges of the second half get the components of
    the first half as their ends, whose sizes and densities are summed.  A range
    then needs no other, and its merges are told one after the other in a task.
    """
    from .graph import node_index, nodes, numbered

    index = keep(node_index(nodes(edges)))  # numbers in order of id, so that the smallest stands for a cluster
    n = max(index.count(), 1)
    density = edges.groupBy(F.col("src").alias("id")).agg(F.avg("dist").alias("mean"))
    info = keep(index.join(density, "id", "left").select(F.lit(0).cast("long").alias("g"), F.col("idx").cast("long").alias("node"), F.lit(1).cast("long").alias("size"), F.coalesce("mean", F.lit(0.0)).alias("total")))
    number = lambda c, to: index.select(F.col("id").alias(c), F.col("idx").cast("long").alias(to))
    steps = numbered(spanning_forest(edges), ["w", "a", "b"], "step").join(number("a", "ca"), "a").join(number("b", "cb"), "b")
    now = keep(steps.select(F.lit(0).cast("long").alias("g"), F.col("step").cast("long").alias("step"), "a", "b", "w", "ca", "cb"))
    width, count = most, now.count()
    while width < count:
        width *= 2
    ends = lambda e: e.select("g", F.col("ca").alias("node")).union(e.select("g", "cb")).distinct()
    key = lambda c: F.col("g") * n + F.col(c)
    while width > most:
        width //= 2
        early = F.floor(F.col("step") / width) % 2 == 0
        first, second = now.where(early), now.where(~early)
        touched = keep(ends(first))
        found = labels(touched.select(key("node").alias("id")), first.select(key("ca").alias("a"), key("cb").alias("b")))
        found = keep(found.select(F.floor(F.col("id") / n).alias("g"), (F.col("id") % n).alias("node"), (F.col("cluster") % n).alias("label")))
        to = lambda c: found.select("g", F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        second = second.join(to("ca"), ["g", "ca"], "left").join(to("cb"), ["g", "cb"], "left").select("g", "step", "a", "b", "w", F.coalesce("ca_label", "ca").alias("ca"), F.coalesce("cb_label", "cb").alias("cb"))
        second = keep(second)
        joined = info.join(found, ["g", "node"], "left").groupBy("g", F.coalesce("label", "node").alias("node")).agg(F.sum("size").alias("size"), F.sum("total").alias("total"))
        late = lambda df: df.withColumn("g", F.col("g") * 2 + 1)
        info = info.join(touched, ["g", "node"], "left_semi").withColumn("g", F.col("g") * 2).unionByName(late(joined.join(ends(second), ["g", "node"], "left_semi")))
        now, info = keep(first.withColumn("g", F.col("g") * 2).unionByName(late(second))), keep(info)
    heads = info.join(index.select(F.col("idx").cast("long").alias("node"), "id"), "node")
    heads = heads.select("g", F.lit(-1).cast("long").alias("step"), F.col("id").alias("a"), F.col("size").alias("b"), F.col("total").alias("w"), F.col("node").alias("ca"), F.lit(-1).cast("long").alias("cb"))
    rows = heads.unionByName(now).repartition("g").sortWithinPartitions("g", "step", "ca")
    return rows.mapInArrow(_merges, MERGE)


def _merges(batches):
    """Merges of each range; its clusters come first (step -1: ca is the number, a the name, b the size, w the total of densities)."""
    g, sets, held = None, None, {}
    for batch in batches:
        out = []
        for group, step, a, b, w, ca, cb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != g:
                g, sets, held = group, UnionFind(), {}
            if step < 0:
                held[ca] = (a, b, w)
                continue
            ra, rb = sets.find(ca), sets.find(cb)
            (na, sa, ta), (nb, sb, tb) = held[ra], held[rb]
            out.append((step + 1, a, b, w, na, nb, sa, sb, ta / sa, tb / sb))
            sets.union(ra, rb)
            held[sets.find(ra)] = (min(na, nb), sa + sb, ta + tb)
        if out:
            names = [f.split()[0] for f in MERGE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)


def h0_barcode(edges: DataFrame) -> DataFrame:
    """(birth, death): bars of the connected components; those that never merge have no death."""
    from .graph import nodes

    forest = keep(spanning_forest(edges))
    bars = forest.select(F.lit(0.0).alias("birth"), F.col("w").alias("death"))
    open_ = nodes(edges).count() - forest.count()
    return bars.unionByName(edges.sparkSession.range(open_).select(F.lit(0.0).alias("birth"), F.lit(None).cast("double").alias("death")))
