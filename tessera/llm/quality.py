"""Quality scores by co-training two classifiers on different views of a document.

One classifier sees the text (hashed pairs of bytes, kinds of characters, how
much repeats), the other the page's metadata (source, language, size).  Both
start from the labelled documents.  In each round each view labels, of all
unlabelled documents, those it is surest of, for the other to learn from.

What a view says is trusted as far as the labelled documents bear it out: by
cross-validation on them each view gets the value above (below) which it was
right often enough, and gives labels beyond it only, so a view that knows
nothing gives none.  What a view has learned from the other in a round is kept
only if its cross-validated loss falls by it; rounds end when neither view keeps
anything.  The finished views are calibrated on cross-validated values of the
labelled documents, and combined where that lowers the loss by more than its
error, else the better view scores alone.

Definitions:

* Learning takes at most ``most_labelled`` labelled documents, those with the
  smallest hashes, and all unlabelled ones, of which a round moves ``each`` a
  view and class at most; equal texts count once.  All documents are scored.
* Null text counts as empty; null metadata is a value of its own.  Texts of any
  length are taken whole.
* Documents with equal values are taken by id and hash.  Rows without a doc_id
  are scored, not learned from.
* Labels that contradict each other count as the lower quality.  Without both
  classes among the labels (as from an empty table) every score is 0.5.
* Each row of the input gives a row; further columns are passed over.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_batches, bucket, materialise, release, table

PAIRS = 1024
KINDS = np.zeros(256, np.int64)
KINDS[list(range(97, 123))] = 1
KINDS[list(range(65, 91))] = 2
KINDS[list(range(48, 58))] = 3
KINDS[[32, 9]] = 4
KINDS[[10, 13]] = 5
KINDS[[33, 34, 39, 44, 45, 46, 58, 59, 63]] = 6
KINDS[128:] = 7
META = 64 + 32 + 32


def text_features(texts: list[str | None]) -> np.ndarray:
    """The text view: one row for each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = len(raw)
    size = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((n, PAIRS + 8 + 3), np.float32)
    if not size.sum():
        return out
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(n), size)
    pair = (data[:-1].astype(np.int64) * 131 + data[1:]) * 2654435761 >> 7 & (PAIRS - 1)
    same = doc[:-1] == doc[1:]
    counts = np.bincount((doc[:-1] * PAIRS + pair)[same], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, :PAIRS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)) * 3
    kinds = np.bincount(doc * 8 + KINDS[data], minlength=n * 8).reshape(n, 8)
    out[:, PAIRS : PAIRS + 8] = np.sqrt(kinds / np.maximum(size, 1)[:, None]) * 2
    h, many = shingles.words(raw)
    if len(h):
        owner = np.repeat(np.arange(n), many)
        apart = np.unique(shingles.mix(h + owner.astype(np.uint64) * shingles.MULT), return_index=True)[1]
        distinct = np.bincount(owner[apart], minlength=n)
        out[:, PAIRS + 8] = 2 * distinct / np.maximum(many, 1)
        out[:, PAIRS + 9] = np.log1p(many) / 4
        out[:, PAIRS + 10] = size / np.maximum(many, 1) / 10
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """The metadata view: hashed source and language, size in steps."""
    out = np.zeros((len(source), META), np.float32)
    for i, (s, c, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32(repr(s).encode()) % 64] = 1
        out[i, 64 + zlib.crc32(repr(c).encode()) % 32] = 1
        out[i, 96 + (31 if n is None else min(30, int(2 * np.log2(max(n, 0) + 1))))] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    weight = weight / weight.sum()
    rate = 1.0 / (0.25 * float((weight * (x * x).sum(1)).sum()) + ridge)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ (weight * (p - y)) + ridge * np.r_[v[:-1], 0])
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def _value(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Model:
    """Weights of the two views, of their calibrations and of the combination."""

    def __init__(self, views=None, calibrations=None, combined=None):
        self.views, self.calibrations, self.combined = views, calibrations, combined

    def scores(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(xs[0])
        if self.views is None:
            return (np.full(n, 0.5),) * 3
        logits = [_value(_value(x, w)[:, None], c) for x, w, c in zip(xs, self.views, self.calibrations, strict=True)]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(_value(np.stack(logits, 1), self.combined))


FOLDS = 4


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _losses(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    return -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1))


class Learner:
    """One view: labelled rows, what the other view gave, and what cross-validation says of it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, given=None):
        self.x, self.y, self.fold = x, y.astype(float), fold
        self.given = given if given is not None else (np.zeros((0, x.shape[1]), np.float32), np.zeros(0))
        self.weights = self._fit(np.ones(len(y), bool))
        self.values = np.zeros(len(y))  # of each labelled row, by a machine that did not learn from its label
        for k in range(FOLDS):
            self.values[fold == k] = _value(x[fold == k], self._fit(fold != k))
        self.calibration = _logistic(self.values[:, None], self.y, np.ones(len(y)), 1e-4)
        self.losses = _losses(_sigmoid(_value(self.values[:, None], self.calibration)), y)

    def _fit(self, rows: np.ndarray) -> np.ndarray:
        gx, gy = self.given
        return _logistic(np.vstack([self.x[rows], gx]), np.r_[self.y[rows], gy], np.r_[np.ones(int(rows.sum())), np.full(len(gy), 0.3)])

    def with_more(self, x: np.ndarray, y: np.ndarray) -> Learner:
        return Learner(self.x, self.y, self.fold, (np.vstack([self.given[0], x]), np.r_[self.given[1], y]))

    def trusted(self, right: float) -> tuple[float, float]:
        """(low, high): values beyond which the lower bound (95 %) of the share of right labels is at least ``right``."""
        out = []
        for sign, truth in ((-1, 1 - self.y), (1, self.y)):
            order = np.argsort(-sign * self.values, kind="stable")
            n = np.arange(1, len(order) + 1)
            p, z = np.cumsum(truth[order]) / n, 1.645
            bound = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)  # Wilson's
            good = np.flatnonzero(bound >= right)
            out.append(float(self.values[order[good[-1]]]) if len(good) else sign * np.inf)
        return out[0], out[1]


def fit(xs: list[np.ndarray], y: np.ndarray, surest, rounds: int = 3, right: float = 0.8) -> Model:
    """Co-train on the labelled rows ``xs`` (one matrix a view).

    ``surest(weights, bounds)`` gives for each view the matrices of both views
    and the labels of the unlabelled rows it is surest of, beyond its bounds.
    """
    if len(y) < 10 or min(np.bincount(y, minlength=2)) < 2:
        return Model()
    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):  # both classes in every fold, as far as they go
        at = np.flatnonzero(y == c)
        fold[at] = np.arange(len(at)) % FOLDS
    views = [Learner(x, y, fold) for x in xs]
    for _ in range(rounds):
        bounds = [v.trusted(right) for v in views]
        if not np.isfinite(bounds).any():
            break
        given, kept = surest([v.weights for v in views], bounds), False
        more = [views[k].with_more(given[1 - k][0][k], given[1 - k][1]) if len(given[1 - k][1]) else views[k] for k in (0, 1)]
        for k in (0, 1):
            if more[k].losses.mean() < views[k].losses.mean() - 1e-4:
                views[k], kept = more[k], True
        if not kept:
            break
    logits = np.stack([_value(v.values[:, None], v.calibration) for v in views], 1)
    best = int(np.argmin([v.losses.mean() for v in views]))
    alone = np.zeros(3)
    alone[best] = 1.0
    crossed = np.zeros(len(y))
    for k in range(FOLDS):
        out = fold == k
        crossed[out] = _value(logits[out], _logistic(logits[~out], y[~out].astype(float), np.ones(int((~out).sum())), 1e-3))
    gain = views[best].losses - _losses(_sigmoid(crossed), y)
    better = gain.mean() > gain.std() / np.sqrt(len(y))
    combined = _logistic(logits, y.astype(float), np.ones(len(y)), 1e-3) if better else alone
    return Model([v.weights for v in views], [v.calibration for v in views], combined)


COLUMNS = ["doc_id", "text", "source", "lang", "n_chars"]


def surest_rows(docs: DataFrame, labelled: DataFrame, weights: list[np.ndarray], bounds: list[tuple[float, float]], batch_bytes: int = 4 << 20) -> DataFrame:
    """(view, label, th, sure, doc_id): of ``docs`` (COLUMNS, th) without the ids in ``labelled``, each text that is beyond a view's bound, once a view and label.

    Labelled rows are left out after texts have become values, so that only ids
    and values are shuffled, and by one plan at every size.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((weights, bounds))  # a fixed number of weights

    def run(batches):
        weights, bounds = shipped.value
        for b in arrow_batches(batches, batch_bytes):
            cols = [b.column(i).to_pylist() for i in range(5)]
            values = [_value(x, w) for x, w in zip([text_features(cols[1]), meta_features(*cols[2:])], weights, strict=True)]
            at = np.flatnonzero(np.any([(v <= low) | (v >= high) for v, (low, high) in zip(values, bounds, strict=True)], 0))
            if len(at):
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(5).take(rows), *(pa.array(v[at].astype(float)) for v in values)], ["doc_id", "th", "v0", "v1"])

    values = docs.select(*COLUMNS, "th").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, v0 double, v1 double")
    free = values.join(labelled.hint("merge"), "doc_id", "left_anti")
    cases = [F.struct(F.lit(v).alias("view"), F.lit(c).alias("label"), F.col(f"v{v}") * sign, F.lit(sign * float(bounds[v][c])).alias("least")) for v in (0, 1) for c, sign in ((0, -1.0), (1, 1.0))]
    beyond = free.select("doc_id", "th", F.inline(F.array(*(c.cast("struct<view:int,label:int,sure:double,least:double>") for c in cases)))).where("sure >= least")
    best = F.max(F.struct("sure", F.bitwise_not(F.xxhash64("doc_id")), "doc_id")).alias("m")
    return beyond.groupBy("view", "label", "th").agg(best).select("view", "label", "th", "m.sure", "m.doc_id")


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, rounds: int = 3, each: int = 150) -> Model:
    """Fit on documents (COLUMNS) and labels (doc_id, quality); a round is one pass over the unlabelled documents."""
    h = F.xxhash64("doc_id")
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = one.orderBy(h, "doc_id").limit(most_labelled)
    rows = docs.select(*COLUMNS).join(F.broadcast(known), "doc_id").orderBy(h, "doc_id", "text").limit(most_labelled).collect()  # known: bounded by the limit
    texts = docs.select(*COLUMNS, F.xxhash64("text").alias("th")).where("doc_id is not null")
    taken: set = set()

    def views(got):  # few texts at a time, so that the driver never holds the features' intermediates of all
        parts = [text_features([r["text"] for r in got[k : k + 100]]) for k in range(0, len(got), 100)]
        text = np.concatenate([np.zeros((0, PAIRS + 11), np.float32), *parts])
        return [text, meta_features(*[[r[c] for r in got] for c in COLUMNS[2:]])]

    def surest(weights, bounds):
        most = each + len(taken)  # what earlier rounds took may come again
        found = materialise(surest_rows(texts, one.select("doc_id"), weights, bounds), "surest")
        got = {(v, c): [r for r in found.where((F.col("view") == v) & (F.col("label") == c)).orderBy(F.desc("sure"), h, "doc_id", "th").limit(most).collect() if (r["doc_id"], r["th"]) not in taken][:each] for v in (0, 1) for c in (0, 1)}
        keys = sorted({(r["doc_id"], r["th"]) for rows in got.values() for r in rows})
        taken.update(keys)
        ids = docs.sparkSession.createDataFrame(keys, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long")
        text = {(r["doc_id"], r["th"]): r for r in texts.join(F.broadcast(ids), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).collect()} if keys else {}  # at most 4 * each
        release(found)
        out = []
        for v in (0, 1):
            rows = [(text[r["doc_id"], r["th"]], c) for c in (0, 1) for r in got[v, c]]
            out.append((views([r for r, _ in rows]), np.array([float(c) for _, c in rows])))
        return out

    return fit(views(rows), np.array([r["quality"] for r in rows], np.int64), surest, rounds)


def score(docs: DataFrame, model: Model, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, p_text, p_meta, score of every row of ``docs`` (COLUMNS)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        for b in arrow_batches(batches, batch_bytes):
            cols = [b.column(i).to_pylist() for i in range(5)]
            a, m, s = shipped.value.scores([text_features(cols[1]), meta_features(*cols[2:])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a.astype(float)), pa.array(m.astype(float)), pa.array(s.astype(float))], ["doc_id", "p_text", "p_meta", "score"])

    return docs.select(*COLUMNS).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, p_text double, p_meta double, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket("doc_id", 5) == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "p_text", "p_meta", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
