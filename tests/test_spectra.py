"""Eigenpairs by restarted block Lanczos, held against dense decompositions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import diffusion, knn, linalg
from tessera.params import DiffusionParams


def held(spark, a, count, **more):
    values, block, off = linalg.eigen(linalg.dense(spark, a), count, **more)
    got = {r["i"]: r["x"] for r in block.collect()}
    u = np.array([got.get(i, [0.0] * len(values)) for i in range(len(a))])
    return values, u, off


def test_eigen_of_flat_spectrum(spark):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(150, 150)))[0]
    true = np.r_[1.0, 1.0, -0.98, np.linspace(0.6, 0.01, 147)]  # a repeated value, a negative one, small gaps
    a = (q * true) @ q.T
    values, u, off = held(spark, a, 20)
    assert np.abs(np.abs(values) - np.sort(np.abs(true))[::-1][:20]).max() < 1e-6
    assert off.max() <= 1.0001e-4 and np.abs(np.linalg.norm(a @ u - u * values, axis=0) - off).max() < 1e-6
    assert np.abs(u.T @ u - np.eye(20)).max() < 1e-7
    assert all(c[np.abs(c).argmax()] > 0 for c in u.T)


def test_eigen_of_low_rank_and_small(spark):
    x = np.arange(12.0).reshape(6, 2)
    a = x @ x.T
    values, u, _ = held(spark, a, 4)
    assert len(values) == 2 and np.allclose(values, np.linalg.eigvalsh(a)[::-1][:2]) and np.allclose((u * values) @ u.T, a)
    none = linalg.dense(spark, a).where("false")
    values, block, off = linalg.eigen(none, 3)
    assert len(values) == len(off) == 0 and block.count() == 0


def test_dmap_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    turn = rng.uniform(0, 2 * np.pi, 120)
    x = np.c_[np.cos(turn), 0.5 * np.sin(turn), rng.normal(0, 0.01, 120)]
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    edges = knn.knn(points, 8, "l2")
    params = DiffusionParams(asked_dim=2)
    lap = diffusion.laplacian_of(edges, params)
    one = {r["id"]: r["coords"] for r in diffusion.embed_laplacian(lap, params).collect()}
    spread = diffusion.Laplacian(lap.sym.repartition(7), lap.norm, lap.scales)
    two = {r["id"]: r["coords"] for r in diffusion.embed_laplacian(spread, params).collect()}
    assert len(one) == 120 and all(two[k] == pytest.approx(v, abs=2e-3) for k, v in one.items())
    s, u, _, ids, _ = linalg.svd_full(lap.sym.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w"))
    values, block, _ = linalg.eigen(lap.sym.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w"), 3)
    got = {r["i"]: r["x"] for r in block.collect()}
    assert np.allclose(np.abs(values), s[:3], atol=1e-6)
    assert np.abs(np.abs(np.array([got[i] for i in ids]).T @ u[:, :3]) - np.eye(3)).max() < 1e-3
