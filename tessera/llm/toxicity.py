"""Toxicity scores from a subsequence string-kernel support vector machine.

Two words are alike under the gap-weighted subsequence kernel when they share
subsequences of three characters; a gap costs ``decay`` for each character it
spans, so that insults with inserted, dropped or spaced characters stay close.
Nyström landmarks give each training word a finite feature vector, a linear
support vector machine is fitted on it, and the machine is folded back into one
weight for each subsequence, which scores any word without the landmarks: the
decision function is the same sum in another order.

A document scores as its worst word (multiple-instance learning: a toxic
document has at least one toxic word), calibrated to a probability.

Definitions:

* A word is a run of characters between white space, lower-cased, without
  punctuation at its ends; one with punctuation inside counts without it, too.  Single characters in a row (four or more), parted by
  up to two characters that are neither letters nor digits, also count as one
  word ("i d i o t").
* Null or empty text has no word; it scores as the mildest training word does.
* Labels of a document that contradict each other count as toxic.  Labels
  without a document, and null labels, are passed over.
* Training takes at most ``train_each`` labelled documents of each class, those
  with the smallest hashes; without one class every score is 0.
* Each row of the input gives a row.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, bucket, table

A = 64  # codes of characters; 0 pads
SPAN = 7  # characters that a subsequence may span
DECAY = 0.9
OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
SPACED = re.compile(r"(?<!\w)(?:\w[^\w\n]{1,2}){3,}\w(?!\w)")
EDGE = re.compile(r"^\W+|\W+$")


def words_of(text: str | None) -> set[str]:
    """Distinct words of a text."""
    if not text:
        return set()
    low = text.lower()
    out = set()
    for w in set(low.split()):
        if not w.isalnum():
            w = EDGE.sub("", w)
            out.add("".join(c for c in w if c.isalnum()))
        out.add(w)
    for run in SPACED.findall(low):
        out.add("".join(c for c in run if c.isalnum()))
    out.discard("")
    return out


def stretched(word: str) -> list[str]:
    """A word with one character put between any two, and with one between all."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in "-1"] + ["-".join(word), ".".join(word)]


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes with SPAN zeros after each word, where each begins, its length)."""
    pad = "\0" * SPAN
    points = np.frombuffer((pad.join(words) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, LOW[np.minimum(points, 127)], 37 + points % 26).astype(np.int64)
    codes[points == 0] = 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.cumsum(size + SPAN) - size - SPAN, size


def _low() -> np.ndarray:
    t = np.full(128, 63, np.int64)  # any punctuation
    t[ord("a") : ord("z") + 1] = np.arange(1, 27)
    t[ord("0") : ord("9") + 1] = np.arange(27, 37)
    return t


LOW = _low()


def norms(size: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector, by its number of characters (subsequences taken as distinct)."""
    total = np.zeros(len(size))
    for _, j in OFFSETS:
        total += np.maximum(size - j, 0) * DECAY ** (2 * (j + 1))
    return np.sqrt(np.maximum(total, 1e-9))


def subsequences(codes: np.ndarray):
    """For each pair of offsets: the subsequence that begins at each character, and its weight."""
    n = len(codes) - SPAN
    a = codes[:n] * (A * A)
    for i, j in OFFSETS:
        b, c = codes[i : i + n], codes[j : j + n]
        yield np.where((codes[:n] > 0) & (c > 0), a + b * A + c, 0), DECAY ** (j + 1)


def score_words(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """Decision values: sums of the weights of a word's subsequences over its norm."""
    if not words:
        return np.zeros(0)
    codes, start, size = encode(words)
    total = np.zeros(len(codes))
    for at, w in subsequences(codes):
        total[: len(at)] += w * weight[at]
    return np.add.reduceat(total, start) / norms(size) + bias


class Model:
    """Subsequence weights, bias and calibration (``value`` -> logistic(a * value + b))."""

    def __init__(self, weight: np.ndarray, bias: float, a: float, b: float, empty: float, landmarks: list[str]):
        self.weight, self.bias, self.a, self.b, self.empty, self.landmarks = weight, bias, a, b, empty, landmarks

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * value + self.b, -30, 30)))


def kernel_to(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of each word with each landmark."""
    table = np.zeros((A**3, len(landmarks)), np.float32)
    codes, start, size = encode(landmarks)
    owner = np.repeat(np.arange(len(landmarks)), size + SPAN)[: len(codes) - SPAN]
    scale = norms(size)
    for at, w in subsequences(codes):
        np.add.at(table, (at, owner), (w / scale[owner]).astype(np.float32))
    table[0] = 0
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for k in range(0, len(words), 2000):
        codes, start, size = encode(words[k : k + 2000])
        total = np.zeros((len(codes), len(landmarks)), np.float32)
        for at, w in subsequences(codes):
            total[: len(at)] += np.float32(w) * table[at]
        out[k : k + 2000] = np.add.reduceat(total, start, axis=0) / norms(size)[:, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        margin = 1 - y * (x1 @ w)
        on = margin > 0
        xa = x1[on] * cost[on, None]
        new = np.linalg.solve(ridge + xa.T @ x1[on], xa.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's calibration with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([v, np.ones_like(v)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fold(marks: list[str], alpha: np.ndarray) -> np.ndarray:
    """One weight for each subsequence: the sum of the landmarks' features, ``alpha`` times each."""
    folded = np.zeros(A**3)
    codes, _, size = encode(marks)
    owner = np.repeat(np.arange(len(marks)), size + SPAN)[: len(codes) - SPAN]
    alpha = alpha / norms(size)
    for sub, weight in subsequences(codes):
        np.add.at(folded, sub, weight * alpha[owner])
    folded[0] = 0
    return folded


def fit(texts: list[str], toxic: list[int], n_landmarks: int = 96, n_clean_words: int = 12_000, rounds: int = 4, seed: int = 7) -> Model:
    """Fit on labelled texts, each a bag of words of which the worst makes it toxic."""
    bags = [sorted(words_of(t)) for t in texts]
    y = np.array(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(A**3), 0.0, 0.0, -30.0, 0.0, [])
    pos: dict[str, int] = {}
    neg: dict[str, int] = {}
    for bag, label in zip(bags, y, strict=True):
        side = pos if label else neg
        for w in bag:
            side[w] = side.get(w, 0) + 1
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    odds = {w: math.log((c + 0.2) / (n_pos + 0.4)) - math.log((neg.get(w, 0) + 0.2) / (n_neg + 0.4)) for w, c in pos.items()}
    ranked = sorted(odds, key=lambda w: (-odds[w], w))
    rng = np.random.default_rng(seed)
    clean = every_clean = sorted(neg)
    clean = [clean[i] for i in sorted(rng.choice(len(clean), min(len(clean), n_clean_words), replace=False))] if clean else []
    pool = ranked[: 6 * n_landmarks]
    near = kernel_to(pool, pool) if pool else np.zeros((0, 0))
    chosen: list[int] = []
    for i in range(len(pool)):  # landmarks: telling words, none close to another
        if all(near[i, j] < 0.8 for j in chosen) and len(chosen) < n_landmarks * 2 // 3:
            chosen.append(i)
    marks = [pool[i] for i in chosen]
    marks += [clean[i] for i in rng.choice(len(clean), min(len(clean), n_landmarks - len(marks)), replace=False)] if clean else []
    marks = list(dict.fromkeys(marks))
    k = kernel_to(marks, marks).astype(float)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-3 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    toxic_bags = [bag for bag, label in zip(bags, y, strict=True) if label and bag]
    positive_words = sorted({w for bag in toxic_bags for w in bag})
    at = {w: i for i, w in enumerate(positive_words)}
    z_pos, z_neg = kernel_to(positive_words, marks) @ whiten, kernel_to(clean, marks) @ whiten
    witness = [max(bag, key=lambda w: (odds[w], w)) for bag in toxic_bags]
    folded, bias, gapped = np.zeros(A**3), 0.0, []
    hard: list[str] = []
    for _ in range(rounds):
        rows = np.array([at[x] for x in witness])
        often = [q for q in sorted(set(witness)) if 100 * witness.count(q) >= len(witness)]
        gapped = sorted({v for q in often for v in stretched(q)})
        parts = [z_pos[rows], *[kernel_to(g, marks) @ whiten if g else z_pos[:0] for g in (gapped, hard)], z_neg]
        n = [len(p) for p in parts]
        target = np.r_[np.ones(n[0] + n[1]), -np.ones(n[2] + n[3])]
        cost = np.r_[np.full(n[0], 4e4 / max(1, n[0])), np.full(n[1], 5e3 / max(1, n[1])), np.full(n[2], 5e3 / max(1, n[2])), np.full(n[3], 1e4 / max(1, n[3]))]
        w, bias = _svm(np.vstack(parts), target, cost)
        folded = fold(marks, whiten @ w)
        value = score_words(positive_words, folded, bias)
        worst_clean = score_words(every_clean, folded, bias)
        hard = [every_clean[i] for i in np.argsort(-worst_clean, kind="stable")[:2000]]
        fresh = [max(bag, key=lambda q: (value[at[q]] + 0.25 * odds[q], q)) for bag in toxic_bags]
        witness = fresh
    every = sorted({q for bag in bags for q in bag})
    value = dict(zip(every, score_words(every, folded, bias).tolist(), strict=True))
    empty = min(value.values(), default=0.0)
    worst = np.array([max((value[q] for q in bag), default=empty) for bag in bags])
    if gapped:  # stretched insults are toxic too: the calibration must not ask for an exact hit
        worst, y = np.r_[worst, score_words(gapped, folded, bias)], np.r_[y, np.ones(len(gapped), int)]
    a, b = _logistic(worst, y)
    return Model(folded, bias, a, b, empty, marks)


def train(docs: DataFrame, labels: DataFrame, train_each: int = 2500) -> Model:
    """Fit on at most ``train_each`` labelled documents of each class (doc_id, toxic; doc_id, text)."""
    h = F.xxhash64(F.col("doc_id"))
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label in (0, 1):
        part = one.where(F.col("toxic") == label).orderBy(h, "doc_id").limit(train_each)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")  # at most 2 * train_each ids
    rows = texts.select("doc_id", "text", "toxic").orderBy(h, "doc_id", "text").limit(2 * train_each).collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model, batch_bytes: int = 16 << 20, held_words: int = 400_000) -> DataFrame:
    """doc_id, score and the worst word of every row of ``docs`` (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each subsequence: a fixed size

    def run(batches):
        m = shipped.value
        value: dict[str, float] = {}
        for b in arrow_batches(batches, batch_bytes):
            bags = [words_of(t) for t in b.column(1).to_pylist()]
            if len(value) > held_words:
                value.clear()
            new = list(set().union(*bags).difference(value))
            value.update(zip(new, score_words(new, m.weight, m.bias).tolist(), strict=True))
            get = value.__getitem__
            worst = [max(bag, key=get) if bag else None for bag in bags]
            top = np.array([m.empty if w is None else value[w] for w in worst])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.probability(top)), pa.array(worst, pa.string())], ["doc_id", "score", "worst_word"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, worst_word string")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(bucket("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst_word")
