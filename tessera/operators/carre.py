"""Carré du champ: mean, covariance and distances of the random walk at each point."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DiffusionParams
from .diffusion import Laplacian, laplacian_of

DECILES = [k / 10 for k in range(1, 10)]


def walk(edges: DataFrame, params: DiffusionParams | None = None) -> Laplacian:
    """The kernel that the operators below use: epsil 1.5, 12 neighbours, alfa and beta 0."""
    return laplacian_of(edges, params or DiffusionParams(alfa=0.0, beta=0.0, epsil=1.5, gnbn=12))


def means(lap: Laplacian, points: DataFrame) -> DataFrame:
    """(id, j, m): mean of coordinate j over the walk from each point."""
    p = lap.transitions().join(points.select(F.col("id").alias("dst"), "v"), "dst")
    return p.select(F.col("src").alias("id"), "p", F.posexplode("v").alias("j", "x")).groupBy("id", "j").agg(F.sum(F.col("p") * F.col("x")).alias("m"))


def apply_fvec(lap: Laplacian, points: DataFrame, f: Callable[[Column], Column], g: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, mean, mean_g, cov, scale): the carré du champ of two vector functions of the coordinates, of any widths.

    ``f`` and ``g`` (``f``, if left out) make an array column of the column of
    coordinates; ``cov`` has a row for each component of f.
    """
    maps = points.select("id", f(F.col("v")).alias("f"), (g or f)(F.col("v")).alias("g"))
    return cross_covariance(lap, maps)


def cross_covariance(lap: Laplacian, maps: DataFrame) -> DataFrame:
    """(id, mean, mean_g, cov, scale): means and cross-covariance, row by row, of ``f`` and ``g`` over the walk from each point, the latter over twice the squared scale.

    ``maps``: id, f, g, arrays of one width each.  Points dealt and sorted by id
    are added up as they stream by, in differences to the first of each point, so that a
    hub with many neighbours takes no more memory than another.  A point of the
    walk that ``maps`` lacks, or whose arrays are null, counts as nothing.
    """
    at = maps.where(F.col("f").isNotNull() & F.col("g").isNotNull()).select(F.col("id").alias("dst"), "f", "g")
    rows = lap.transitions().join(at, "dst").join(lap.scales.select(F.col("id").alias("src"), "s"), "src").select("src", "p", "s", "f", "g")

    def finish(src, s, f0, g0, total, width):
        """Rows of points from their sums (p, p f, p g, p f g) of differences to f0 and g0."""
        n, m = width
        p, pf, pg, pfg = total[:, :1], total[:, 1 : n + 1], total[:, n + 1 : n + m + 1], total[:, n + m + 1 :].reshape(-1, n, m)
        mf, mg = pf + p * f0, pg + p * g0
        d, e = f0 - mf, g0 - mg
        cov = (pfg + pf[:, :, None] * e[:, None, :] + d[:, :, None] * pg[:, None, :] + p[:, :, None] * d[:, :, None] * e[:, None, :]) / (2 * s[:, None, None] ** 2)
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(mf.tolist()), pa.array(mg.tolist()), pa.array(cov.reshape(len(s), -1).tolist()), pa.array(s)], ["id", "mean", "mean_g", "cov", "scale"])

    def run(batches):
        held = None  # the last point seen: it may go on
        for b in batches:
            if not b.num_rows:
                continue
            f_all, g_all = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in (3, 4))
            src_all, p_all, s_all = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            width = f_all.shape[1], g_all.shape[1]
            step = max(1, (1 << 20) // (width[0] * width[1]))
            for k in range(0, b.num_rows, step):
                src, p, s, f, g = (x[k : k + step] for x in (src_all, p_all, s_all, f_all, g_all))
                first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
                many = np.diff(np.r_[first, len(src)])
                f0, g0 = f[first].copy(), g[first].copy()
                goes_on = held is not None and held[0][0] == src[0]
                if goes_on:
                    f0[0], g0[0] = held[2][0], held[3][0]
                df, dg = f - np.repeat(f0, many, 0), g - np.repeat(g0, many, 0)
                each = np.hstack([np.ones((len(p), 1)), df, dg, (df[:, :, None] * dg[:, None, :]).reshape(len(p), -1)]) * p[:, None]
                now = [src[first], s[first], f0, g0, np.add.reduceat(each, first)]
                if goes_on:
                    now[4][0] += held[4][0]
                elif held is not None:
                    yield finish(*held, width)
                if len(first) > 1:
                    yield finish(*[x[:-1] for x in now], width)
                held = [x[-1:] for x in now]
        if held is not None:
            yield finish(*held, (held[2].shape[1], held[3].shape[1]))

    return rows.repartition("src").sortWithinPartitions("src").mapInArrow(run, "id long, mean array<double>, mean_g array<double>, cov array<double>, scale double")


def covariance(lap: Laplacian, points: DataFrame) -> DataFrame:
    """(id, mean, cov, scale): mean and covariance (row by row) of the walk, the latter over twice the squared scale."""
    return apply_fvec(lap, points, lambda v: v).drop("mean_g")


def _dim(cov):
    return F.sqrt(F.size(cov)).cast("int")


def traces(cov: DataFrame) -> DataFrame:
    n = _dim("cov")
    diagonal = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get("cov", k * (n + 1)))
    return cov.select("id", F.aggregate(diagonal, F.lit(0.0), lambda a, x: a + x).alias("trace"))


def spectra(cov: DataFrame) -> DataFrame:
    """(id, spectrum): singular values of each covariance, largest first."""

    def run(batches):
        for t in batches:
            out = []
            for c in t["cov"]:
                n = int(len(c) ** 0.5)
                out.append(np.linalg.svd(np.asarray(c, float).reshape(n, n), compute_uv=False).tolist())
            yield pd.DataFrame({"id": t["id"], "spectrum": out})

    return cov.select("id", "cov").mapInPandas(run, "id long, spectrum array<double>")


def spectrum_deciles(spectrum: DataFrame) -> DataFrame:
    """(id, decile, rank): how many values it takes to reach each tenth of the trace."""
    running = F.transform(F.sequence(F.lit(1), F.size("spectrum")), lambda k: F.aggregate(F.slice("spectrum", 1, k), F.lit(0.0), lambda a, x: a + x))
    s = spectrum.select("id", running.alias("r")).withColumn("total", F.element_at("r", -1))
    return s.select("id", "r", "total", F.explode(F.array(*map(F.lit, DECILES))).alias("decile")).select("id", "decile", F.size(F.filter("r", lambda x: x < F.col("decile") * F.col("total"))).alias("rank"))


def distances(cov: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, dist): upper bound of the Bures distance between the covariances of two ids; an error for an unknown id."""
    n = _dim("ca")
    x, y = cov.select(F.col("id").alias("a"), F.col("cov").alias("ca")), cov.select(F.col("id").alias("b"), F.col("cov").alias("cb"))
    e = pairs.join(x, "a", "left").join(y, "b", "left")
    e = e.where(F.when(F.col("ca").isNull() | F.col("cb").isNull(), F.raise_error(F.lit("unknown id")).cast("boolean")).otherwise(F.lit(True)))
    at = F.sequence(F.lit(0), F.size("ca") - 1)
    add = lambda col: F.aggregate(col, F.lit(0.0), lambda a, v: a + v)
    trace = lambda c: add(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(c, k * (n + 1))))
    mixed = add(F.transform(at, lambda k: F.get("ca", k) * F.get("cb", (k % n) * n + F.floor(k / n).cast("int"))))
    return e.select("a", "b", F.sqrt(F.greatest(trace("ca") + trace("cb") - 2 * F.sqrt(F.greatest(mixed, F.lit(0.0))), F.lit(0.0))).alias("dist"))


def gamma(lap: Laplacian, values: DataFrame) -> DataFrame:
    """(id, gamma): mean of f g less the product of their means over the walk; ``values``: id, f, g."""
    p = lap.transitions().join(values.select(F.col("id").alias("dst"), "f", "g"), "dst")
    w = F.col("p")
    return p.groupBy(F.col("src").alias("id")).agg((F.sum(w * F.col("f") * F.col("g")) - F.sum(w * F.col("f")) * F.sum(w * F.col("g"))).alias("gamma"))


def contingency(pairs: DataFrame) -> DataFrame:
    """(l1, l2, nb, mean, std) of ``dist`` by unordered pair of labels (la, lb)."""
    return pairs.groupBy(F.greatest("la", "lb").alias("l1"), F.least("la", "lb").alias("l2")).agg(F.count(F.lit(1)).alias("nb"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("std"))


def representatives(points: DataFrame) -> DataFrame:
    """(label, id): the first point of each label."""
    return points.groupBy("label").agg(F.min("id").alias("id"))


def lower_triangle(table: DataFrame, value: str) -> DataFrame:
    """One row a label, one column for each label that is not larger."""
    return table.where(F.col("l1") >= F.col("l2")).groupBy("l1").pivot("l2").agg(F.first(value)).orderBy("l1")
