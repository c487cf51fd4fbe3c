"""Neighbour descent and the layered index against exact neighbours."""

import numpy as np
import pytest

from tessera.functions import vectors
from tessera.operators import descent, knn, levels, navigate


def cloud(spark, x):
    return spark.createDataFrame([(i * 3, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine"])
def test_descent_finds_neighbours(spark, metric):
    x = np.random.default_rng(1).random((900, 6)).astype(np.float32) + 0.1
    stats = []
    got = descent.descent(cloud(spark, x), 8, metric, stats=stats).collect()
    name = vectors.metric_name(metric)
    hits = 0
    lists = {}
    for r in got:
        lists.setdefault(r["src"] // 3, []).append((r["rank"], r["dst"] // 3, r["dist"]))
    assert len(lists) == 900 and all(sorted(n for n, *_ in v) == list(range(1, 9)) for v in lists.values())
    for i, v in lists.items():
        d = knn.direct(name, x[i].astype(float), x.astype(float))
        assert all(dist == pytest.approx(d[j], abs=1e-9) for _, j, dist in v) and i not in [j for _, j, _ in v]
        hits += len({j for _, j, _ in v} & set(np.argsort(np.where(np.arange(900) == i, np.inf, d))[:8].tolist()))
    assert hits >= 0.95 * 900 * 8
    assert [c for _, c in stats] == sorted((c for _, c in stats), reverse=True)


def test_descent_of_equal_points_and_of_few(spark):
    x = np.random.default_rng(2).random((400, 4))
    x[::3] = x[0]  # a third of all points
    got = descent.descent(cloud(spark, x), 5).collect()
    assert len(got) == 2000 and all(r["dist"] == 0 for r in got if r["src"] // 3 % 3 == 0)
    few = descent.descent(cloud(spark, x[1:4]), 5).collect()
    assert sorted((r["src"], r["dst"]) for r in few) == [(a, b) for a in (0, 3, 6) for b in (0, 3, 6) if a != b]
    assert descent.descent(cloud(spark, x).where("false"), 5).count() == 0


@pytest.fixture(scope="module")
def index(spark):
    x = np.random.default_rng(3).random((700, 5))
    df = cloud(spark, x)
    lv = levels.levels(df, 6)
    return df, lv, navigate.build(df, lv, 10)


def test_longer_lists_find_more(spark, index):
    df, _, ix = index
    new = cloud(spark, np.random.default_rng(4).random((60, 5))).selectExpr("-id - 1 id", "v")
    exact = knn.knn(df, 5, queries=new).persist()
    found = []
    for ef in (5, 20, 80):
        stats = []
        got = navigate.search(ix, new, 5, ef, beam=2, upper=2, stats=stats)
        found.append((knn.recall(exact, got).first()["recall"], sum(n for _, n in stats)))
    assert found[0][0] <= found[1][0] <= found[2][0] and found[2][0] >= 0.98 and found[0][1] < found[2][1]
    assert ix.top >= 1 and ix.entry.count() <= 64
    own = navigate.search(ix, df.limit(20), 1)
    assert all(r["src"] == r["dst"] and r["dist"] == 0 for r in own.collect())


def test_points_are_projected_by_search(spark, index):
    df, lv, _ = index
    got = {r["id"]: r for r in navigate.project_by_search(df, lv, 1, nbconn=8).collect()}
    want = {r["id"]: r for r in levels.project(df, lv, 1).collect()}
    assert got.keys() == want.keys()
    assert sum(got[i]["upper_id"] == want[i]["upper_id"] for i in want) >= 0.95 * len(want)
    assert all(got[i]["dist"] >= want[i]["dist"] - 1e-9 for i in want)


def test_descent_is_held_against_exact_neighbours(spark):
    df = cloud(spark, np.random.default_rng(5).standard_normal((1500, 40)))
    exact = knn.knn(df, 5).persist()
    assert knn.recall(exact, descent.descent(df, 5, width=5, draw=2, rounds=2, enough=None)).first()["recall"] < 0.8
    assert knn.recall(exact, descent.descent(df, 5, width=5, draw=2, rounds=2)).first()["recall"] >= 0.9
    same = cloud(spark, np.repeat(np.random.default_rng(6).random((10, 3)), 40, 0))  # ids decide ties
    assert knn.recall(knn.knn(same, 5), descent.descent(same, 5)).first()["recall"] >= 0.9


def test_searches_are_held_against_exact_neighbours(spark):
    df = cloud(spark, np.random.default_rng(7).standard_normal((1500, 40)))
    lv = levels.levels(df, 6)
    new = cloud(spark, np.random.default_rng(8).standard_normal((80, 40))).selectExpr("-id - 1 id", "v")
    ix = navigate.build(df, lv, 4)
    exact = knn.knn(df, 5, queries=new).persist()
    assert knn.recall(exact, navigate.search(ix, new, 5, 5, beam=2, upper=2)).first()["recall"] < 0.8
    assert knn.recall(exact, navigate.search(ix, new, 5, 5, beam=2, upper=2, enough=0.93)).first()["recall"] >= 0.9
    own = navigate.search(ix, df.limit(20), 1, enough=1.1).collect()
    assert len(own) == 20 and all(r["src"] == r["dst"] and r["dist"] == 0 for r in own)


def test_most_points_are_projected_onto_the_nearest_among_many(spark):
    df = cloud(spark, np.random.default_rng(9).standard_normal((2500, 48)))
    lv = levels.levels(df, 3)
    want = {r["id"]: r["upper_id"] for r in levels.project(df, lv, 1).collect()}
    got = {r["id"]: r["upper_id"] for r in navigate.project_by_search(df, lv, 1, nbconn=3, ef=3).collect()}
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in want) >= 0.9 * len(want)
