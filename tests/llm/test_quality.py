"""Which unlabelled rows the views of co-training give each other, and what choosing them shuffles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

EACH = 5


@pytest.fixture
def by_sorting(spark):
    """Joins as on large tables: no table is small enough to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def surest_of_train(d, labels, monkeypatch):
    caught = []
    monkeypatch.setattr(quality, "fit", lambda xs, y, surest, rounds: caught.append(surest))
    quality.train(d, labels, each=EACH)
    return caught[0]


def brute(d, labelled, weights, bounds, taken):
    """For each view the texts and labels of the surest rows: one a text, ties by the hash of the id."""
    rows = d.where("doc_id is not null").select("*", F.xxhash64("doc_id").alias("h")).collect()
    rows = [r for r in rows if r["doc_id"] not in labelled]
    xs = [quality.text_features([r["text"] for r in rows]), quality.meta_features(*[[r[c] for r in rows] for c in ("source", "lang", "n_chars")])]
    out = []
    for v in (0, 1):
        value, chosen = quality._value(xs[v], weights[v]), []
        for c, sign in ((0, -1), (1, 1)):
            order = sorted((i for i in range(len(rows)) if sign * value[i] >= sign * bounds[v][c]), key=lambda i: (-sign * value[i], rows[i]["h"]))
            first = {}
            for i in order:
                first.setdefault(rows[i]["text"], i)
            chosen.append([i for i in first.values() if rows[i]["text"] not in taken][:EACH])
        out.append([(rows[i]["text"], c) for c in (0, 1) for i in chosen[c]])
    return out


@pytest.fixture
def case(spark):
    """(documents, labels, weights, bounds): long texts, one of them in more rows than a view may give, and ties of metadata."""
    rnd = random.Random(4)
    text = lambda: "".join(chr(rnd.randint(33, 126)) for _ in range(1500)) + "e" * rnd.randint(0, 900)
    rows = [(i, "e" * 2400 if 100 <= i < 200 else text(), "en", "ab"[i % 2], 100) for i in range(600)] + [(None, text(), "en", "a", 100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    labels = d.where("doc_id % 4 = 0 and (doc_id < 100 or doc_id >= 200)").select("doc_id", (F.col("doc_id") % 8 == 0).cast("int").alias("quality"))
    weights = [np.zeros(quality.PAIRS + 12), np.zeros(quality.META + 1)]
    weights[0][np.flatnonzero(quality.text_features(["ee"])[0, : quality.PAIRS])] = 1.0
    weights[1][:64] = quality.meta_features(["a"], ["en"], [100])[0, :64] * 2 - 1  # two values only: 1 for source a, -1 for b
    return d, labels, weights, [(0.5, 0.5), (-np.inf, 1.0)]


def test_surest_rows_against_brute_force(case, monkeypatch):
    d, labels, weights, bounds = case
    surest, taken = surest_of_train(d, labels, monkeypatch), set()
    labelled = {r["doc_id"] for r in labels.collect()}
    for _ in range(2):  # a second round gives the next rows
        wanted, got = brute(d, labelled, weights, bounds, taken), surest(weights, bounds)
        assert [len(w) for w in wanted] == [2 * EACH, EACH]
        for v in (0, 1):
            assert list(got[v][1]) == [c for _, c in wanted[v]]
            assert np.array_equal(got[v][0][0], quality.text_features([t for t, _ in wanted[v]]))
        taken |= {t for w in wanted for t, _ in w}


def test_surest_rows_shuffle_no_texts(spark, by_sorting, case, monkeypatch):
    d, labels, weights, bounds = case
    surest = surest_of_train(d, labels, monkeypatch)
    before = shuffled_bytes(spark)
    surest(weights, bounds)
    assert 0 < shuffled_bytes(spark) - before < 0.1 * d.agg(F.sum(F.length("text"))).first()[0]
