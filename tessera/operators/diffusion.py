"""Diffusion kernels, Laplacians and diffusion maps of a nearest-neighbour graph."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip
from ..params import DiffusionParams
from . import linalg
from .lineage import keep
from .proba import FLOOR

MOST = 10.0  # coordinates are held within


def local_scales(edges: DataFrame, gnbn: int | None = None) -> DataFrame:
    """(id, s): root of the summed squares of the first ``gnbn`` distances over the number of all."""
    d2 = F.col("dist") * F.col("dist")
    used = d2 if gnbn is None else F.when(F.col("rank") <= gnbn, d2).otherwise(0.0)
    return edges.groupBy(F.col("src").alias("id")).agg(F.sqrt(F.sum(used) / F.count(F.lit(1))).alias("s"))


def l1_scales(edges: DataFrame, gnbn: int | None = None) -> DataFrame:
    """(id, s): mean of the nearest distances of a node and its first ``gnbn`` neighbours."""
    d1 = edges.where("rank = 1").select(F.col("src").alias("n"), F.col("dist").alias("d1"))
    near = edges if gnbn is None else edges.where(F.col("rank") <= gnbn)
    total = near.join(d1, near.dst == d1.n).groupBy("src").agg(F.sum("d1").alias("t"), F.count(F.lit(1)).alias("k"))
    own = d1.select(F.col("n").alias("src"), F.col("d1").alias("own"))
    return total.join(own, "src").select(F.col("src").alias("id"), ((F.col("t") + F.col("own")) / (F.col("k") + 1)).alias("s"))


def node_scales(edges: DataFrame, gnbn: int | None = None) -> DataFrame:
    """(id, s, normed, mean): local scales, zeros replaced by the mean of all, and over the mean."""
    s = local_scales(edges, gnbn)
    mean = s.agg(F.avg("s").alias("mean"))
    filled = F.when(F.col("s") <= 0, F.col("mean")).otherwise(F.col("s"))
    return s.join(F.broadcast(mean), how="cross").select("id", filled.alias("s"), (filled / F.col("mean")).alias("normed"), "mean")


def kernel(edges: DataFrame, scales: DataFrame, epsil: float) -> DataFrame:
    """(src, dst, w): Gaussian of the distance over the geometric mean of two scales (id, s), 1 on the diagonal.

    A node whose distances do not differ, or are all 0, has even weights that sum to 1.
    """
    a = scales.select(F.col("id").alias("src"), F.col("s").alias("si"))
    b = scales.select(F.col("id").alias("dst"), F.col("s").alias("sj"))
    ends = edges.groupBy("src").agg(F.min("dist").alias("lo"), F.max(F.when(F.col("dist") > 0, F.col("dist"))).alias("hi"), F.count(F.lit(1)).alias("k"))
    e = edges.join(ends, "src").join(a, "src").join(b, "dst")
    even = F.col("hi").isNull() | (F.col("hi") <= F.col("lo"))
    w = F.greatest(F.exp(-(F.col("dist") * F.col("dist")) / (epsil * F.col("si") * F.col("sj"))), F.lit(FLOOR))
    out = e.select("src", "dst", F.when(even, 1 / (F.col("k") + 1)).otherwise(w).alias("w"))
    own = ends.select("src", F.col("src").alias("dst"), F.when(even, 1 / (F.col("k") + 1)).otherwise(F.lit(1.0)).alias("w"))
    return out.unionByName(own)


def symmetric(k: DataFrame) -> DataFrame:
    half = k.select("src", "dst", (F.col("w") / 2).alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def density(k: DataFrame) -> DataFrame:
    """(id, q): row sums of the symmetric kernel over their mean."""
    q = symmetric(k).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("q"))
    mean = q.agg(F.avg("q").alias("m"))
    return q.join(F.broadcast(mean), how="cross").select("id", (F.col("q") / F.col("m")).alias("q"))


def beta_scales(k: DataFrame, scales: DataFrame, beta: float) -> DataFrame:
    """(id, s): the density to the power ``beta`` times the mean scale."""
    mean = scales.select("id", "mean")
    return density(k).join(mean, "id").select("id", (F.pow("q", F.lit(float(beta))) * F.col("mean")).alias("s"))


def dmap_kernel(edges: DataFrame, params: DiffusionParams) -> tuple[DataFrame, DataFrame]:
    """(kernel, node scales): variable width for beta under 0, else one width for all.

    Both are kept, as the Laplacian reads them several times.
    """
    scales = keep(node_scales(edges, params.gnbn))
    if params.beta < 0:
        k = kernel(edges, scales, params.epsil)
        return keep(kernel(edges, keep(beta_scales(keep(k), scales, params.beta)), params.epsil)), scales
    return keep(kernel(edges, scales.select("id", F.col("mean").alias("s")), params.epsil)), scales


@dataclass
class Laplacian:
    """``sym`` (src, dst, w): the normalised symmetric kernel; ``norm`` (id, norm): roots of degrees; ``scales``."""

    sym: DataFrame
    norm: DataFrame
    scales: DataFrame

    def transitions(self) -> DataFrame:
        """(src, dst, p): the random walk; rows sum to 1."""
        return self._with_norms().select("src", "dst", (F.col("w") * F.col("nj") / F.col("ni")).alias("p"))

    def _with_norms(self) -> DataFrame:
        a = self.norm.select(F.col("id").alias("src"), F.col("norm").alias("ni"))
        b = self.norm.select(F.col("id").alias("dst"), F.col("norm").alias("nj"))
        return self.sym.join(a, "src").join(b, "dst")

    def generator(self) -> DataFrame:
        """(src, dst, w): the walk less the identity, over the products of the normed scales."""
        a = self.scales.select(F.col("id").alias("src"), F.col("normed").alias("si"))
        b = self.scales.select(F.col("id").alias("dst"), F.col("normed").alias("sj"))
        walk = F.col("w") * F.col("nj") / (F.col("ni") * F.col("si") * F.col("sj"))
        diagonal = F.when(F.col("src") == F.col("dst"), 1 / (F.col("si") * F.col("si"))).otherwise(0.0)
        return self._with_norms().join(a, "src").join(b, "dst").select("src", "dst", (walk - diagonal).alias("w"))


def laplacian(k: DataFrame, scales: DataFrame, alfa: float) -> Laplacian:
    """Symmetric kernel, density to the power -alfa on both sides, degrees, normalisation."""
    g = keep(symmetric(k))
    q = g.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("q"))
    mean = q.agg(F.avg("q").alias("m"))
    q = q.join(F.broadcast(mean), how="cross").select("id", F.pow(F.col("q") / F.col("m"), F.lit(float(alfa))).alias("q"))
    a, b = q.select(F.col("id").alias("src"), F.col("q").alias("qi")), q.select(F.col("id").alias("dst"), F.col("q").alias("qj"))
    g = keep(g.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / (F.col("qi") * F.col("qj"))).alias("w")))
    n = keep(g.groupBy(F.col("src").alias("id")).agg(F.sqrt(F.sum("w")).alias("norm")))
    a, b = n.select(F.col("id").alias("src"), F.col("norm").alias("ni")), n.select(F.col("id").alias("dst"), F.col("norm").alias("nj"))
    return Laplacian(keep(g.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / (F.col("ni") * F.col("nj"))).alias("w"))), n, scales)


def laplacian_of(edges: DataFrame, params: DiffusionParams) -> Laplacian:
    k, scales = dmap_kernel(edges, params)
    return laplacian(k, scales, params.alfa)


def embed_laplacian(lap: Laplacian, params: DiffusionParams) -> DataFrame:
    """(id, coords): singular vectors after the first, times powers of their values, over scale and root of the norm."""
    values, block, _ = linalg.eigen(lap.sym.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w"), max(params.asked_dim + 1, 3))
    s = np.abs(values)
    if not len(s):
        return block.select(F.col("i").alias("id"), F.col("x").alias("coords"))
    dim = min(params.asked_dim, len(s) - 1)
    lam = s / s[0]
    time = params.t
    if time is None:
        ratio = lam[2] / lam[1] if len(lam) > 2 and lam[1] > 0 else 0.0
        time = min(5.0, log(0.9) / log(ratio)) if 0 < ratio < 1 else 5.0
    mean = lap.norm.agg(F.avg("norm").alias("m"))
    degree = F.col("norm") / F.col("m")
    weight = F.col("normed") * (degree if params.exact_rw else F.sqrt(degree))
    joined = block.select(F.col("i").alias("id"), "x").join(lap.norm, "id").join(lap.scales, "id").join(F.broadcast(mean), how="cross")
    return joined.select("id", F.array(*[clip(F.lit(float(lam[j + 1] ** time)) * F.col("x")[j + 1] / weight, MOST) for j in range(dim)]).alias("coords"))


def dmap_embed(edges: DataFrame, params: DiffusionParams = DiffusionParams()) -> DataFrame:  # noqa: B008
    """The diffusion map (id, coords) of a graph."""
    return embed_laplacian(laplacian_of(edges, params), params)


def legacy_embed(k: DataFrame, dim: int, t: float | None = None) -> DataFrame:
    """Diffusion map of a probability kernel: degree-normalised, neither clipped nor scaled."""
    from .proba import legacy_laplacian

    sym, deg = legacy_laplacian(k)
    values, block, _ = linalg.eigen(sym.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w"), max(dim + 1, 3))
    s = np.abs(values)
    lam = s / s[0]
    time = t if t is not None else min(5.0, log(0.9) / log(lam[2] / lam[1])) if len(lam) > 2 and 0 < lam[2] < lam[1] else 5.0
    mean = deg.agg(F.avg("norm").alias("m"))
    joined = block.select(F.col("i").alias("id"), "x").join(deg, "id").join(F.broadcast(mean), how="cross")
    return joined.select("id", F.array(*[F.lit(float(lam[j + 1] ** time)) * F.col("x")[j + 1] / F.sqrt(F.col("norm") / F.col("m")) for j in range(min(dim, len(s) - 1))]).alias("coords"))
