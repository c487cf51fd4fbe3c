"""Operators against analytic values, brute force and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import entropy, roots, vectors
from tessera.operators import diffusion, dimension, embedding, graph, hubness, knn, levels, linalg, mst, proba
from tessera.params import DiffusionParams, EmbedderParams, Epsil, Rank
from tessera.sources import csv, exports, idx

FOUR = [[1, 0, 0, 0, 2], [0, 0, 3, 0, 0], [0, 0, 0, 0, 0], [0, 2, 0, 0, 0]]


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(1).random((120, 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    return x, df, knn.knn(df, 8).persist()


def brute(x, k, d):
    out = {}
    for i in range(len(x)):
        near = sorted((d(x[i], x[j]), j) for j in range(len(x)) if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("method", ["tiles", "sql"])
def test_knn(spark, cloud, method):
    x, df, _ = cloud
    got = {r["src"]: [n["dst"] for n in r["neighbours"]] for r in graph.adjacency(knn.knn(df, 5, "l1", method, rows=32)).collect()}
    assert got == brute(x, 5, lambda a, b: np.abs(a - b).sum())


def test_knn_duplicates_and_few_points(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "id long, v array<double>")
    got = {(r["src"], r["dst"]): r["dist"] for r in knn.knn(df, 10).collect()}
    assert len(got) == 6 and got[1, 2] == 0 and got[1, 3] == pytest.approx(math.sqrt(41))


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine", "jeffreys", "jensen_shannon"])
def test_knn_of_many_equal_vectors(spark, metric):
    x = np.random.default_rng(7).random((400, 5)) + 0.1
    x /= x.sum(1)[:, None]
    x[300:] = x[300]
    df = spark.createDataFrame([((i * 37) % 400, [float(v) for v in x[(i * 37) % 400]]) for i in range(400)], "id long, v array<double>")
    got = {r["src"]: [n["dst"] for n in r["neighbours"]] for r in graph.adjacency(knn.knn(df.coalesce(1), 10, metric)).collect()}
    name = vectors.metric_name(metric)
    for i in range(300, 400):
        assert got[i] == [j for j in range(300, 312) if j != i][:10]
    for i in range(300):
        d = knn.direct(name, x[i], x)
        assert got[i] == [int(j) for j in np.lexsort((np.arange(400), d)) if j != i][:10]


def test_approximate_recall(cloud):
    _, df, exact = cloud
    assert knn.recall(exact, knn.knn(df, 8, method="approx", bits=2, tables=10)).first()[0] > 0.8


def test_spectra_of_whole_vectors(spark, tmp_path):
    from tessera.operators import carre
    from tessera.plans import catalog

    x = np.random.default_rng(3).random((60, 64))
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    lap = carre.walk(catalog.edges(spark, str(tmp_path)))
    p = np.zeros((60, 60))
    for r in lap.transitions().collect():
        p[r["src"], r["dst"]] = r["p"]
    s = {r["id"]: r["s"] for r in lap.scales.collect()}
    got = {r["id"]: r["spectrum"] for r in catalog.cdc_spectrum(spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for i, spectrum in got.items():
        centred = x - p[i] @ x
        want = np.linalg.svd((centred * p[i][:, None]).T @ centred / (2 * s[i] ** 2), compute_uv=False)
        assert len(spectrum) == 64 and spectrum == pytest.approx(want, abs=1e-9)


def test_embeddings_are_registered_with_default_parameters(monkeypatch):
    from tessera.plans import catalog

    for name in ("points", "edges", "keep"):
        monkeypatch.setattr(catalog, name, lambda *a: None)
    for name in ("levels", "layer_knn", "project"):
        monkeypatch.setattr(catalog.levels, name, lambda *a: None)
    for name in ("embed", "hierarchical_embed"):
        monkeypatch.setattr(catalog.embedding, name, lambda *a: a[-1])
    assert catalog.entropy_embed(None, "") == catalog.entropy_embed_hier(None, "") == EmbedderParams()


def test_unknown_metric():
    with pytest.raises(ValueError):
        vectors.metric_name("DistNone")


def test_graph_statistics(cloud):
    x, _, e = cloud
    assert graph.in_degrees(e).agg(F.sum("degree")).first()[0] == 120 * 8
    assert graph.radius_at_quantile(e, 1.5).first()[0] == 0
    assert sorted(r["idx"] for r in graph.node_index(graph.nodes(e)).collect()) == list(range(120))
    counts = [r["hubness"] for r in hubness.hubness(e).collect()]
    c = np.array(counts, float)
    assert hubness.standard_third_moment(hubness.hubness(e)).first()[0] == pytest.approx(((c - c.mean()) ** 3).mean() / c.std(ddof=1) ** 3)
    assert hubness.top_hubs(e, 3).count() == 3
    with pytest.raises(LookupError):
        graph.out_edges(e, 10**6)


def test_dimension_of_a_cube(spark):
    x = np.random.default_rng(2).random((600, 2))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    e = knn.knn(df, 20).persist()
    assert 1.5 < dimension.estimate(e, None).first()["dim"] < 2.9  # the estimate is biased upwards
    assert 1.6 < dimension.two_nn(e).first()["dim"] < 2.4


def test_probabilities(cloud):
    _, _, e = cloud
    p = proba.proba_edges(e).persist()
    assert p.groupBy("src").agg(F.abs(F.sum("w") - 1).alias("d")).agg(F.max("d")).first()[0] < 1e-9
    assert proba.perplexities(p).agg(F.max("perplexity")).first()[0] <= 8.0001


def test_equal_distances_are_even(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 1), (0, 2, 1.0, 2), (1, 0, 0.0, 1), (2, 0, 1.0, 1)], graph.SCHEMA)
    got = {(r["src"], r["dst"]): r["w"] for r in proba.proba_edges(e).collect()}
    assert got[0, 1] == got[0, 2] == 0.5 and got[1, 0] == 1


def test_walk_and_diffusion_map(cloud):
    _, _, e = cloud
    params = DiffusionParams.variable_bandwidth()
    lap = diffusion.laplacian_of(e, params)
    assert lap.transitions().groupBy("src").agg(F.abs(F.sum("p") - 1).alias("d")).agg(F.max("d")).first()[0] < 1e-9
    coords = diffusion.embed_laplacian(lap, params).collect()
    assert len(coords) == 120 and all(len(r["coords"]) == 2 and max(map(abs, r["coords"])) <= 10 for r in coords)


def test_svd(spark):
    m = linalg.dense(spark, FOUR)
    s, u, _ = linalg.svd(m, Rank(4, 5))
    assert np.allclose(np.sort(s)[::-1][:3], [3, math.sqrt(5), 2], atol=1e-6)
    assert np.allclose(linalg.gram(u)[:3, :3], np.eye(3), atol=1e-6)
    q, width = linalg.adaptive_range(m, Epsil(1e-6, 2, 4))
    assert linalg.residual(m, q, width) < 1e-5
    assert np.allclose(linalg.svd_full(m)[0][:3], [3, math.sqrt(5), 2])


def test_first_singular_value(spark):
    m = linalg.dense(spark, [[9, -1, 2], [-2, 8, 4], [1, 1, 8]])
    assert linalg.first_singular_value(m, 1e-6) == pytest.approx(10.6811457, abs=1e-4)


def test_forest_against_kruskal(spark, cloud):
    _, _, e = cloud
    rows = [(r["src"], r["dst"], r["dist"]) for r in e.collect()]
    tree = list(mst.kruskal(rows))
    for driver in (mst.DRIVER, 0):
        got = mst.spanning_forest(e, driver).collect()
        assert len(got) == len(tree) and sum(r["w"] for r in got) == pytest.approx(sum(w for *_, w in tree))


def test_single_linkage(spark):
    x = [(0, 0.0), (1, 0.1), (2, 0.25), (3, 5.0), (4, 5.1)]
    df = spark.createDataFrame([(i, [v, 0.0]) for i, v in x], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in mst.single_linkage(knn.knn(df, 3), 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    links = spark.createDataFrame([(1, 0), (2, 1), (4, 3)], "a long, b long")
    assert {r["id"]: r["cluster"] for r in mst.labels(df, links, 0).collect()} == got


def test_union_find_halves_paths():
    sets = mst.UnionFind({0: 0, 1: 0, 2: 1, 3: 2, 4: 3})
    assert sets.find(4) == 0 and sets.parents[4] == 2


def test_embedding_draws_neighbours_together(spark, cloud):
    _, _, e = cloud
    params = EmbedderParams(nb_grad_batch=10)
    k = proba.proba_edges(e).persist()
    low = embedding.embedded_scales(proba.scales(k))
    first = embedding.random_init(graph.nodes(e), 2, 10.0, params.seed).persist()
    done = embedding.optimise(k, first, params)

    def spread(coords):
        at = {r["id"]: np.array(r["coords"]) for r in coords.collect()}
        near = np.mean([np.linalg.norm(at[r["src"]] - at[r["dst"]]) for r in e.collect()])
        return near / np.mean([np.linalg.norm(a - b) for a in at.values() for b in at.values()])

    assert spread(done) < 0.7 * spread(first)
    assert done.orderBy("id").collect() == embedding.optimise(k, first, params).orderBy("id").collect()
    assert embedding.cross_entropy(k, done, low).first()[0] > 0


def test_levels_and_projection(cloud):
    _, df, e = cloud
    lv = levels.levels(df, 8).persist()
    p = levels.project(df, lv, 1)
    assert p.count() == 120 and p.where("id = upper_id and dist <> 0").isEmpty()
    assert levels.fix_all(levels.project_by_edges(e, lv, 1), e, lv).count() <= 120


def test_bisection():
    assert roots.bisect(lambda x: x * x, 0, 5, 2) == pytest.approx(math.sqrt(2), abs=1e-4)
    assert roots.bisect(lambda x: 1 / (x * x), 0.2, 5, 0.5, False) == pytest.approx(math.sqrt(2), abs=1e-4)
    with pytest.raises(ValueError):
        roots.bisect(lambda x: x, 0, 1, 3)


def test_umap_scales(cloud):
    _, _, e = cloud
    r = roots.umap_scales(e, 3.0).first()
    assert sum(r["weights"]) == pytest.approx(3.0, abs=1e-3)


def test_renyi(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "x double")
    h = entropy.renyi_entropies(df, "x", [1.0, 2.0]).first()
    assert h["h_1"] == pytest.approx(1.5 * math.log(2)) and h["h_2"] == pytest.approx(-math.log(0.375))


def test_parameters_are_held():
    assert DiffusionParams(alfa=5, epsil=9).alfa == 1 and DiffusionParams(epsil=9).epsil == 4
    with pytest.raises(ValueError):
        DiffusionParams(beta=0.5)


def test_csv_round_trip(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("# one\n% two\n1,2\n3,4.5\n")
    got = [(r["id"], r["v"]) for r in csv.read_vectors_csv(spark, str(f)).orderBy("id").collect()]
    assert got == [(0, [1.0, 2.0]), (1, [3.0, 4.5])] and csv.header_size(spark, str(f)) == 2
    assert csv.read_vectors_csv(spark, str(f), skip_first=True).count() == 1
    lines = csv.coords_lines(spark.createDataFrame([(7, [1.2345, -0.00123, 0.0])], "id long, coords array<double>"), "id").first()[0]
    assert lines == "7,1.23450e0,-1.23000e-3,0.00000e0"


@pytest.mark.parametrize("text", ["1\n2\n", "1,2\n3\n", "1,2\n3,x\n", ""])
def test_csv_errors(spark, tmp_path, text):
    f = tmp_path / "x.csv"
    f.write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        csv.read_vectors_csv(spark, str(f)).collect()


def test_idx(spark, tmp_path):
    import struct

    (tmp_path / "train-images-idx3-ubyte").write_bytes(struct.pack(">4I", 2051, 3, 2, 2) + bytes(range(12)))
    (tmp_path / "train-labels-idx1-ubyte").write_bytes(struct.pack(">2I", 2049, 3) + bytes([7, 8, 9]))
    got = {r["id"]: (r["label"], r["v"]) for r in idx.read_pair(spark, str(tmp_path)).collect()}
    assert got[1] == (8, [4.0, 5.0, 6.0, 7.0])
    with pytest.raises(ValueError):
        idx.decode_images(b"\0" * 20)


def test_exports(spark, cloud):
    _, df, e = cloud
    assert exports.ripser_triplets(e).count() == 2 * e.count()
    m = exports.local_distance_matrix(df, [0.5, 0.5, 0.5], 4)
    assert m.count() == 10
    assert exports.parse_bson_array(exports.bson_array("limat", [1.0, 2.5])) == ("limat", [1.0, 2.5])
    full = exports.lower_to_full(spark.createDataFrame([(0, 0.0), (1, 3.0), (2, 0.0)], "pos long, d double"))
    assert {(r["r"], r["c"]): r["d"] for r in full.collect()} == {(0, 0): 0.0, (1, 0): 3.0, (0, 1): 3.0, (1, 1): 0.0}


def test_entry_imports():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) > 60 and set(sql) <= set(q)


def test_numbers_and_merges_in_order(spark):
    from tessera.operators import graph, mst

    rows = spark.range(300).select(((F.col("id") * 7919) % 300).alias("v"), F.lit("x").alias("_r"))
    got = graph.numbered(rows.repartition(5), ["v"], "k").collect()
    assert len(got) == 300 and all(r["v"] == r["k"] and r["_r"] == "x" for r in got)
    edges = spark.createDataFrame([(0, 1, 1.0, 1), (1, 2, 3.0, 1), (2, 3, 2.0, 1), (3, 0, 9.0, 1)], graph.SCHEMA)
    assert [tuple(r) for r in mst.dendrogram(edges).orderBy("step").collect()] == [(1, 0, 1, 1.0), (2, 2, 3, 2.0), (3, 1, 2, 3.0)]
    assert mst.single_linkage(edges, 2).select("cluster").distinct().count() == 2


def test_approximate_graph_of_the_embeddings_has_recall_of_nine_tenths(spark):
    p = knn.vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    assert knn.recall(knn.knn(p, 10), knn.knn(p, 10, method="approx")).first()[0] >= 0.9
