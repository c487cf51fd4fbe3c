"""The streamed kernel of exact graphs against brute force, and how little it measures and returns."""

import numpy as np
import pytest

from tessera.operators import knn, nearest

METRICS = ["l2", "l1", "cosine", "jeffreys", "jensen_shannon"]


def brute(metric, k, ids, a, jds, b):
    out = []
    for i, x in zip(ids, a, strict=True):
        d = np.where(jds == i, np.inf, nearest.measured(metric, x[None, :], b))
        out += [(int(i), float(d[j]), int(jds[j])) for j in np.lexsort((jds, d))[:k] if np.isfinite(d[j])]
    return sorted(out)


def clouds():
    rng = np.random.default_rng(1)
    yield rng.standard_normal((1200, 33)).astype(np.float32).astype(float)
    yield rng.standard_normal((900, 9)) * 1e-3 + 1e4  # far from the origin
    yield np.repeat(rng.random((5, 3)), 120, 0)  # many ties
    yield rng.random((1500, 2))  # cells
    yield np.maximum(rng.standard_normal((800, 16)), 0) * 1e-9
    yield np.vstack([rng.random((700, 8)), rng.random((9, 8)) * 1e6, [[np.nan, *range(7)], [np.inf, *range(7)], [0] * 8]])


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.filterwarnings("ignore")
def test_streamed_rows_are_the_nearest(metric):
    for x in clouds():
        if metric.startswith("j"):
            x = np.abs(x) / np.maximum(np.abs(x).sum(1, keepdims=True), 1e-300)
        ids = np.random.default_rng(2).permutation(len(x)) * 7 - 50
        ids[5] = ids[6]
        near = nearest.Nearest(metric, 10, ids[:300], x[:300])
        for lo in range(0, len(x), 130):
            near.add(ids[lo : lo + 130], x[lo : lo + 130])
        src, dst, dist = near.result()
        assert sorted(zip(src.tolist(), dist.tolist(), dst.tolist(), strict=True)) == brute(metric, 10, ids[:300], x[:300], ids, x)


@pytest.mark.parametrize(("metric", "most"), [("l2", 0.01), ("l1", 0.05), ("jeffreys", 0.01), ("jensen_shannon", 0.01)])
def test_few_pairs_are_measured(metric, most, monkeypatch):
    x = np.abs(np.random.default_rng(3).standard_normal((20_000, 24)))
    x /= x.sum(1, keepdims=True)
    pairs = []
    old = nearest.measured
    monkeypatch.setattr(nearest, "measured", lambda m, a, b: (pairs.append(len(b)), old(m, a, b))[1])
    near = nearest.Nearest(metric, 10, np.arange(200), x[:200])
    near.add(np.arange(len(x)), x)
    near.result()
    assert sum(pairs) <= most * 200 * len(x)


@pytest.mark.parametrize("metric", ["l1", "jensen_shannon", "jeffreys"])
def test_tasks_return_k_rows_a_query_at_any_number_of_blocks(spark, metric):
    x = np.random.default_rng(4).random((400, 6))
    df = spark.createDataFrame([(i * 3, [float(c) for c in v]) for i, v in enumerate(x / x.sum(1, keepdims=True))], "id long, v array<double>")
    assert knn._tiles(df, df, 5, metric, 16, 1).count() == 2000  # 25 blocks a side
    assert knn._tiles(df, df, 5, metric, 16, 3).count() == 6000
    want = {(r["src"], r["dst"]): r["rank"] for r in knn.knn(df, 5, metric, "sql").collect()}
    for spread in (1, 3):
        assert {(r["src"], r["dst"]): r["rank"] for r in knn.knn(df, 5, metric, rows=16, spread=spread).collect()} == want


def test_hot_buckets_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.random((150, 4)), np.repeat(rng.random((1, 4)), 60, 0)])
    df = spark.createDataFrame([(i * 3, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    want = knn.knn(df, 6, method="approx", tables=4, bits=2).collect()
    monkeypatch.setattr(knn, "HELD", 256)
    assert sorted(knn.knn(df, 6, method="approx", tables=4, bits=2).collect()) == sorted(want)
    new = df.limit(30).selectExpr("-id - 1 id", "v")
    assert knn.knn(df, 6, method="approx", queries=new, tables=4, bits=2).groupBy("src").count().where("count = 6").count() == 30


@pytest.mark.parametrize("metric", METRICS)
def test_columns_return_few_pairs_and_the_same_neighbours(spark, metric, monkeypatch):
    x = np.abs(np.random.default_rng(6).standard_normal((900, 5)))
    x[::9] = x[0]  # ties
    df = spark.createDataFrame([(i * 3, [float(c) for c in v]) for i, v in enumerate(x / x.sum(1, keepdims=True))], "id long, v array<double>")
    seen, old = [], knn.top_k
    monkeypatch.setattr(knn, "top_k", lambda pairs, k: (seen.append(pairs), old(pairs, k))[1])
    got = knn.knn(df, 6, metric, "sql").collect()
    assert seen[-1].count() < 900 * 899 / 3
    monkeypatch.undo()
    want = knn.knn(df, 6, metric).collect()
    name = lambda rows: [(r["src"], r["rank"], r["dst"]) for r in sorted(rows, key=lambda r: (r["src"], r["rank"]))]
    far = [(a["dist"], b["dist"]) for a, b in zip(sorted(got, key=lambda r: (r["src"], r["rank"])), sorted(want, key=lambda r: (r["src"], r["rank"])), strict=True)]
    assert np.allclose(*zip(*far, strict=True), atol=1e-7)
    assert metric != "l2" or name(got) == name(want)


def test_columns_of_few_points_and_of_other_queries(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 0.0])], "id long, v array<double>")
    assert {(r["src"], r["dst"]) for r in knn.knn(df, 10, method="sql").collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    new = spark.createDataFrame([(9, [0.0, 1.9])], "id long, v array<double>")
    assert [(r["dst"], r["rank"]) for r in knn.knn(df, 1, method="sql", queries=new).collect()] == [(2, 1)]
    assert knn.knn(df.where("false"), 3, method="sql").count() == 0
