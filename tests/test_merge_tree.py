"""Merges of single linkage with their clusters, against a serial tree."""

import numpy as np
import pytest

from tessera.operators import knn, mst


def serial(edges):
    """Merges by union-find, for edges (src, dst, dist)."""
    near = {}
    for a, _, w in edges:
        near.setdefault(a, []).append(w)
    ids = {i for a, b, _ in edges for i in (a, b)}
    of = {i: [i] for i in ids}
    light = {}
    for a, b, w in edges:
        pair = (min(a, b), max(a, b))
        light[pair] = min(w, light.get(pair, w))
    out = []
    for (a, b), w in sorted(light.items(), key=lambda e: (e[1], e[0])):
        x, y = of[a], of[b]
        if x is not y:
            mean = lambda c: sum(float(np.mean(near[i])) if i in near else 0.0 for i in c) / len(c)
            out.append((len(out) + 1, a, b, w, min(x), min(y), len(x), len(y), mean(x), mean(y)))
            x = x + y
            for i in x:
                of[i] = x
    return out


@pytest.mark.parametrize("n,most", [(1000, 300), (120, 4096)])
def test_merge_tree_equals_a_serial_one(spark, n, most):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((n, 2)) * 20) if n > 500 else rng.random((n, 2))  # a grid, so that most weights are ties
    x[: n // 10] += 1000
    df = spark.createDataFrame([(3 * i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    e = knn.knn(df, 6).persist()
    got = [tuple(r) for r in mst.merge_tree(e, most).orderBy("step").collect()]
    want = serial([(r["src"], r["dst"], r["dist"]) for r in e.collect()])
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert np.allclose([g[8:] for g in got], [w[8:] for w in want])


def test_merge_tree_of_nothing(spark):
    e = spark.createDataFrame([], "src long, dst long, dist double, rank int")
    assert mst.merge_tree(e).count() == 0
