"""Hard negatives against brute force, and on odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, pivot string, key string, ask string"


def brute(rows, anchors, n_positives=5, n_negatives=10, least=30, most=90):
    """By plain Python, for rows (id, label, v)."""
    first = {}
    for i, label, v in sorted(anchors):
        first.setdefault((i, len(v)), (label, v))
    out = []
    for (a, dim), (label, v) in first.items():
        score = [(sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a and len(w) == dim]
        for s, p, _ in sorted((x for x in score if x[2] == label), key=lambda x: (-x[0], x[1]))[:n_positives]:
            fit = sorted((x for x in score if x[2] != label and least * s <= 100 * x[0] <= most * s), key=lambda x: (-x[0], x[1]))
            out += [(a, p, r + 1, n, s, t) for r, (t, n, _) in enumerate(fit[:n_negatives])]
    return sorted(out)


def result(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def made(spark, rows):
    return spark.createDataFrame(rows, hn.ROWS)


def cases(kind):
    rng = np.random.default_rng(4)
    if kind == "random":
        x = rng.integers(-60, 60, (700, 6))
    elif kind == "groups":  # near copies round a few points, so that intervals leave most out
        x = rng.integers(-300, 300, (9, 6))[rng.integers(0, 9, 700)] + rng.integers(-4, 5, (700, 6))
    else:  # a third of all rows the same, many ties
        x = rng.integers(-2, 3, (600, 3))
        x[::3] = (2, 1, 2)
    labels = rng.integers(0, 4, len(x))
    return [(i, int(l), [int(c) for c in v]) for i, (l, v) in enumerate(zip(labels, x, strict=True))]


@pytest.mark.parametrize("kind,pivots,block", [("random", 3, 64), ("groups", 9, 32), ("copies", 4, 50), ("groups", 1, 5000)])
def test_hard_negatives_against_brute_force(spark, kind, pivots, block, monkeypatch):
    monkeypatch.setattr(hn, "SAMPLE", 120)
    rows = cases(kind)
    d = made(spark, rows)
    got = hn.hard_negatives(d, d.where("id % 20 = 0"), block=block, pivots=pivots)
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert len(want) > 300 and result(got) == want


def test_intervals_hold_what_is_near(spark):
    rows = cases("groups")
    mat = np.array([r[2] for r in rows])
    space = hn.Space(6, float((mat * mat).sum(1).max()), len(rows), np.array([r[1] for r in rows]), np.arange(len(rows)), mat, 9)
    near, keys = space.keys(mat)
    q = mat[:40]
    gap, square, s = space.to_pivots(q), (q * q).sum(1).astype(float), q @ mat.T
    left_out = 0
    for i in range(len(q)):
        d = space.distance(square[i], s[i])
        for radius, hi in ((40.0, 1 << 62), (200.0, int(np.median(s[i]))), (500.0, 1 << 62), (-1.0, 1 << 62)):
            low, high = space.interval(gap[i][near], square[i], np.int64(hi), np.float64(radius))
            inside = (keys >= low) & (keys <= high)
            assert inside[(d <= radius) & (s[i] <= hi)].all() and (radius >= 0 or not inside.any())
            left_out += (~inside).sum()
    assert left_out > 40 * 700  # of 4 * 40 * 700


def test_odd_inputs(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 17), float(i % 3), 0.5], i // 10 % 3) for i in range(0, 1000, 10)]
    rows += [(100, [1.0, 2.0, 3.0], None), (101, None, 1), (102, [1.0, None, 2.0], 1), (103, [nan, 0.0, 0.0], 1), (104, [inf, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0], 1), (200, [1.0, 2.0], 1), (201, [2.0, 2.0], 1), (202, [1.0, 1.0], 2), (0, [2.0, 2.0, 2.0], 0), (26, [9.0, 1.0, 1.0], 2), (26, [9.0, 1.0, 1.0], 2), (300, [], 1)]
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = hn.op13_hard_negatives(spark, str(tmp_path))
    used = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * x)) for x in v]) for i, v, l in rows if None not in (i, v, l) and all(x is not None and np.isfinite(x) for x in v)]
    want = brute(used, [r for r in used if r[0] % 100 == 0])
    assert len(want) > 40 and result(got) == want
    none = hn.mined_rows(spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("false"), "vec_id", "embedding", F.col("label"), 256)
    assert hn.hard_negatives(none, none).count() == 0


def test_large_scores_stay_exact(spark):
    rows = [(i, i % 2, [2**30 + i * 3, 2**29 - i, -(2**28) + i * i]) for i in range(40)]
    d = made(spark, rows)
    assert result(hn.hard_negatives(d, d.where("id % 10 = 0"), least=0, most=100)) == brute(rows, [r for r in rows if r[0] % 10 == 0], least=0, most=100)
