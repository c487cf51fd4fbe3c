"""The block-wise optimisation and its alias tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding, graph, hubness, knn, proba
from tessera.operators.alias import alias_table, draw
from tessera.params import EmbedderParams


@pytest.fixture(scope="module")
def start(spark):
    x = np.random.default_rng(1).random((300, 3))
    df = spark.createDataFrame([(7 * i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    e = knn.knn(df, 8).persist()
    k = proba.proba_edges(e).persist()
    return e, k, embedding.random_init(graph.nodes(e), 2, 10.0, 5).persist()


def rows(coords):
    return [(r["id"], tuple(r["coords"])) for r in coords.orderBy("id").collect()]


def test_alias_tables_draw_by_weight():
    rng = np.random.default_rng(2)
    for w in (np.ones(7), rng.random(50) ** 4 + 1e-9, np.array([5.0]), np.array([0.0, 1.0, 0.0, 3.0]), rng.integers(1, 900, 333)):
        share, other = alias_table(w)
        cells = np.bincount(np.arange(len(w)), weights=share, minlength=len(w)) + np.bincount(other, weights=1 - share, minlength=len(w))
        assert cells / len(w) == pytest.approx(w / w.sum())
        got = np.bincount(draw(share, other, 200_000, rng), minlength=len(w)) / 200_000
        assert np.abs(got - w / w.sum()).max() < 5 * np.sqrt(0.25 / 200_000)


def test_pool_is_drawn_by_hubness_over_blocks():
    dim, nodes, size = 2, 40, 100_000
    w = np.random.default_rng(3).integers(1, 60, 100).astype(float)
    parts = [w[i : i + nodes] for i in range(0, 100, nodes)]
    y = np.arange(200.0).reshape(100, 2)
    batch = [(b, y[b * nodes : b * nodes + len(p)].tobytes(), b"".join(t.tobytes() for t in alias_table(p)), [0, 1, 2], [q.sum() for q in parts]) for b, p in enumerate(parts)]
    import pyarrow as pa

    got = []
    for part in batch:  # each in a task of its own
        rb = pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("b", "y", "alias", "bs", "totals"), part, strict=True)})
        for out in embedding._pool_draws(9, 4, nodes, dim, size)([rb]):
            idx, c = np.frombuffer(out.column(1)[0].as_py(), np.int64), np.frombuffer(out.column(2)[0].as_py(), np.float64).reshape(-1, dim)
            assert (c == y[idx]).all()
            got.append(idx)
    got = np.concatenate(got)
    assert len(got) == size
    assert np.abs(np.bincount(got, minlength=100) / size - w / w.sum()).max() < 5 * np.sqrt(0.25 / size)


def test_result_does_not_depend_on_the_partitioning(spark, start):
    e, k, first = start
    params, hubs = EmbedderParams(nb_grad_batch=3, nb_sampling_by_edge=4), hubness.hubness(e).persist()
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(rows(embedding.optimise(k.repartition(int(n)), first.repartition(5), params, hubs, nodes=64)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 300


def test_one_job_gives_the_same_as_one_job_an_epoch(start):
    _, k, first = start
    params = EmbedderParams(nb_grad_batch=3, nb_sampling_by_edge=4)
    assert rows(embedding.optimise(k, first, params)) == rows(embedding.optimise(k, first, params, one_job=False))


@pytest.mark.parametrize("nodes", [50, 4096])
def test_neighbours_come_together_with_any_blocks(start, nodes):
    e, k, first = start
    done = embedding.optimise(k, first, EmbedderParams(nb_grad_batch=6), hubness.hubness(e), nodes=nodes)
    links = [(r["src"], r["dst"]) for r in e.collect()]

    def spread(coords):
        at = {r["id"]: np.array(r["coords"]) for r in coords.collect()}
        assert len(at) == 300 and all(np.isfinite(c).all() for c in at.values())
        return np.mean([np.linalg.norm(at[a] - at[b]) for a, b in links]) / np.mean([np.linalg.norm(a - b) for a in at.values() for b in at.values()])

    assert spread(done) < 0.6 * spread(first)


def test_both_steps_of_the_hierarchy_draw_by_hubness(start, monkeypatch):
    e, _, first = start
    seen = []

    def noted(kernel, initial, params, hubs=None, **_):
        seen.append(hubs is not None)
        return initial

    monkeypatch.setattr(embedding, "optimise", noted)
    proj = first.select("id", F.col("id").alias("upper_id"), F.lit(0.5).alias("dist"))
    for weighting in (True, False):
        embedding.hierarchical_embed(e, proj, e, EmbedderParams(dmap_init=False, hubness_weighting=weighting)).count()
    assert seen == [True, True, False, False]
    assert embedding.initial_embedding(e, EmbedderParams(dmap_init=False)).count() == 300
