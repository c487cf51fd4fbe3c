"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language.  A document is
parsed greedily against every automaton: a phrase is the longest match from
where the last one ended, and the language whose automaton needs the fewest
phrases per character wins.  The automata are dense transition tables, and all
texts of a batch are parsed in lockstep, one character of each a step, with
whole-array lookups.

Definitions:

* Text is lower-cased; every run of characters that are not letters is one
  space; the parse runs in blocks of ``block`` characters over the whole text
  (a phrase ends with its block), which bounds the number of lockstep steps.  A
  letter that an automaton does not know is a phrase of its own.
* Null text, or text without a letter: ``und`` with score 0.
* Ties: the language first in name order.
* Training takes rows with text and language, of the learning folds only, and
  is bounded by ``train_docs`` documents and ``train_chars`` characters of each
  language, chosen by hash; longer texts are passed over.  Without any
  training row all is ``und``; ``keep_identified`` then keeps what has a letter.
* Every row of ``docs`` gives a row: rows that repeat give equal rows, an empty
  table gives none.  Further columns are passed over.
* Score: ``h_best ** -sharpness`` as a share of the sum over languages, where
  ``h`` is the number of phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, bucket, table

ALPHABET = 64
LETTER = None


def letters() -> np.ndarray:
    """Which code points are letters (one table a process)."""
    global LETTER
    if LETTER is None:
        LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return LETTER


def normalise(text: str) -> np.ndarray:
    """Code points of lower-cased text with one space for each run of other characters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    points = np.where(is_letter, points, 32).astype(np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return points[keep]


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a code sequence; state 0 is the root."""
    link, length, nxt = [-1], [0], [{}]
    last = 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Model:
    """Languages, the code of each code point, and all transition tables end to end."""

    def __init__(self, texts: dict[str, list[str]], train_chars: int):
        self.langs = sorted(texts)
        parts = {}
        for lang in self.langs:
            got, total = [], 0
            for t in texts[lang]:
                p = normalise(t)
                if total and total + len(p) > train_chars:
                    continue
                got += [p, np.array([32], np.uint32)]
                total += len(p) + 1
            parts[lang] = np.concatenate(got)[: 4 * train_chars] if got else np.zeros(0, np.uint32)
        points, counts = np.unique(np.concatenate([*parts.values(), np.zeros(0, np.uint32)]), return_counts=True)
        order = np.lexsort((points, -counts))
        #: Code 0: any other letter, which no automaton knows; codes from ALPHABET on: transitions are in keys and to.
        self.points = np.concatenate([np.sort(points[order[: ALPHABET - 1]]), np.sort(points[order[ALPHABET - 1 :]])])
        keys, rare = [], []
        tables, bases, base = [], [], 0
        for lang in self.langs:
            states = automaton(self.codes(parts[lang]))
            t = np.zeros((len(states), ALPHABET), np.int32)
            for s, go in enumerate(states):
                for code, to in go.items():
                    if code < ALPHABET:
                        t[s, code] = base + to * ALPHABET
                    else:
                        keys.append((base + s * ALPHABET) * (len(self.points) + 1) + int(code))
                        rare.append(base + to * ALPHABET)
            tables.append(t.ravel())
            bases.append(base)
            base += t.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bases = np.array(bases, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(rare, np.int32)[order]

    def codes(self, points: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.zeros(len(points), np.int32)
        lut = np.zeros(int(self.points.max()) + 2, np.int32)
        lut[self.points] = np.arange(1, len(self.points) + 1)
        return lut[np.minimum(points, len(lut) - 1)]

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states of each language (row) for each letter (column); 0 where there is none."""
        if not len(self.keys):
            return self.table[state + c]
        go = self.table[state + np.where(c < ALPHABET, c, 0)]
        rare = np.flatnonzero(c >= ALPHABET)
        if len(rare):
            key = np.broadcast_to(state, go.shape)[:, rare].astype(np.int64) * (len(self.points) + 1) + c[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go[:, rare] = np.where(self.keys[at] == key, self.to[at], 0)
        return go

    def phrases(self, texts: list[np.ndarray], block: int) -> np.ndarray:
        """Phrases that each language (row) needs for each text (column)."""
        lengths = np.array([len(t) for t in texts], np.int64)
        n_blocks = -(-lengths // block)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = (np.cumsum(lengths) - lengths)[owner] + nth * block
        size = np.minimum(block, lengths[owner] - nth * block)
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        if not len(owner):
            return out
        codes = self.codes(np.concatenate(texts))
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")
        roots = self.bases[:, None]
        state = np.repeat(roots, len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)
        for t in range(int(size[0])):
            k = int(active[t])
            c = codes[start[:k] + t]
            now = state[:, :k]
            go = self.step(now, c)
            failed = go == 0
            count[:, :k] += failed | (now == roots)  # phrases are counted where they begin; after an unknown letter that is the root
            again = self.step(roots, c)
            again = np.where(again == 0, roots, again)
            state[:, :k] = np.where(failed, again, go)
        for row in range(len(self.langs)):
            out[row] = np.bincount(owner, weights=count[row], minlength=len(texts)).astype(np.int64)
        return out


def train(docs: DataFrame, train_docs: int = 120, train_chars: int = 30_000) -> Model:
    """Fit on at most about ``train_docs`` texts a language, those with the smallest hashes.

    ``docs``: the learning rows (doc_id, text, lang).  Lengths over
    ``train_chars`` are passed over; texts are used whole.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= train_chars))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({}, train_chars)
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    share = None
    for lang, n in counts.items():
        most = int(min(1.0, 1.5 * train_docs / n) * (1 << 40))
        share = (F.when if share is None else share.when)(F.col("lang") == lang, F.lit(most))
    chosen = rows.select("lang", "text", h.alias("h")).where(F.col("h") < share).orderBy("h", "lang", "text").limit(2 * train_docs * len(counts)).collect()
    texts: dict[str, list[str]] = {}
    for r in chosen:
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model({k: v[:train_docs] for k, v in texts.items()}, train_chars)


def identify(docs: DataFrame, model: Model, block: int = 2048, sharpness: float = 8.0, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, lang_pred, score, phrases and characters of every row of ``docs``."""
    langs = np.array(model.langs + ["und"], object)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train_chars and the number of languages

    def run(batches):
        m = shipped.value
        for b in arrow_batches(batches, batch_bytes):
            texts = [normalise(t) if t else np.zeros(0, np.uint32) for t in b.column(1).to_pylist()]
            n = np.array([len(t) for t in texts], np.int64)
            empty = n == 0
            if m.langs:
                phrases = m.phrases(texts, block)
                h = np.maximum(phrases, 1) / np.maximum(n, 1)
                best = np.argmin(h, axis=0)
                rel = (h.min(axis=0)[None, :] / h) ** sharpness
                score = 1.0 / rel.sum(axis=0)
                won = phrases[best, np.arange(len(texts))] if len(texts) else np.zeros(0, np.int64)
            else:
                empty = np.ones(len(texts), bool)
                best, score, won = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            best = np.where(empty, len(m.langs), best)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(langs[best].tolist(), pa.string()), pa.array(np.where(empty, 0.0, score)), pa.array(np.where(empty, 0, won)), pa.array(n)],
                ["doc_id", "th", "lang_pred", "score", "n_phrases", "n_letters"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, lang_pred string, score double, n_phrases long, n_letters long")


def keep_identified(docs: DataFrame, model: Model, block: int = 2048, batch_bytes: int = 2 << 20) -> DataFrame:
    """The rows and columns of ``docs`` whose language can be told (whose text has a letter), with the identified language as lang.

    Every text is identified, whatever lang says; a stated language that is not
    the identified one is replaced.  With a model that has learned no language,
    and without a column lang of strings, languages stay as they are.
    """
    at = docs.columns.index("text")
    lang = next((i for i, f in enumerate(docs.schema) if f.name == "lang" and f.dataType.simpleString() == "string"), None)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for b in arrow_batches(batches, batch_bytes):
            texts = [normalise(t) if t else np.zeros(0, np.uint32) for t in b.column(at).to_pylist()]
            told = np.array([len(t) > 0 for t in texts], bool)
            if m.langs and lang is not None and told.any():
                best = m.phrases(texts, block).argmin(axis=0)
                said = pa.array([m.langs[k] for k in best.tolist()], b.schema.field(lang).type)
                b = b.set_column(lang, b.schema.field(lang), said)
            yield b.filter(pa.array(told))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(bucket("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_phrases", "n_letters")
