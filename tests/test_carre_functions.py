"""Carré du champ of vector functions, held against numpy."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import carre, knn


def test_vector_functions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5)) + 100
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    lap = carre.walk(knn.knn(points, 6, "l2"))
    p = np.zeros((60, 60))
    for r in lap.transitions().collect():
        p[r["src"], r["dst"]] = r["p"]
    f, g = x[:, :2], np.c_[x * x, x[:, 0]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("10000", "7"):  # points that begin in one batch and end in another
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = carre.apply_fvec(lap, points, lambda v: F.slice(v, 1, 2), lambda v: F.concat(F.transform(v, lambda c: c * c), F.slice(v, 1, 1))).collect()
        assert sorted(r["id"] for r in got) == list(range(60))
        for r in got:
            w = p[r["id"]]
            want = ((f - w @ f) * w[:, None]).T @ (g - w @ g) / (2 * r["scale"] ** 2)
            assert np.allclose(r["mean"], w @ f) and np.allclose(r["mean_g"], w @ g) and np.allclose(np.reshape(r["cov"], (2, 6)), want, atol=1e-6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = {r["id"]: r["cov"] for r in carre.covariance(lap, points).collect()}
    assert all(np.allclose(np.reshape(c, (5, 5)), np.cov(x.T, aweights=p[i], bias=True) / (2 * s * s)) for i, c in whole.items() for s in [next(r["scale"] for r in got if r["id"] == i)])
