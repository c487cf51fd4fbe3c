"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Items are sorted into classes of about equal length.  For each class a window
slides over the words of every document; its 64-bit SimHash is compared with the
fingerprints of the class's items.  A multi-index finds all fingerprints within
the radius: the 64 bits are cut into blocks, and two fingerprints within the
radius agree, up to ``radius // blocks`` bits, in at least one block, so each
block is looked up in a table that holds every item's block with that many bits
flipped.

Windows as long as an item miss it where edits are spread over it, so each item
also has short windows, of a length that its own length and the threshold give
(``Items.run``): a stretch that is similar enough has an unchanged run of the
item's words of at least that length, so the fingerprint of a window inside the
run is equal to one of the item's.  These are looked up at radius 0, and with
them no stretch that is similar enough is missed.

Candidates are verified exactly, for all stretches of the document at once: the
weighted Jaccard similarity of the multisets of five-word shingles of the item
and of a stretch of the document with as many words.

SimHashes of all windows come from running sums: a word's hash becomes 64 small
counters packed in eight (or sixteen) 64-bit integers, and a window's counters are one
difference of the running sums.

Definitions:

* Words are runs of letters, digits and underscores, lower-cased.
* A class's window is shorter than its items by its step at most, and windows
  start at multiples of the step, so an unchanged item contains a whole window
  that is one of the item's own fingerprints.
* Items of fewer words than a shingle are one shingle.  Items without a word
  are never found.  Item ids that repeat are items each.
* A document without words (null, empty) has no row in the result; nor has any
  of an empty table, and an empty benchmark has no row and drops no document.
  Texts of any length are searched whole; rows that repeat give equal rows.
  Further columns are passed over by ``leaks`` and kept by ``clean``.
* Stretches may begin before a document or end after it, and are cut there.
* Result: one row for each document row and item with the best similarity of at
  least ``threshold``; first and last word of that stretch (end exclusive), the
  first of the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, table

SHINGLE = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
MULT = np.uint64(0x100000001B3)
WORDCHAR = None


def word_chars() -> np.ndarray:
    """For each code point 1 if it belongs to a word (one table a process)."""
    global WORDCHAR
    if WORDCHAR is None:
        WORDCHAR = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)
    return WORDCHAR


def _powers(n: int) -> np.ndarray:
    global POWERS
    if len(POWERS) < n:
        POWERS = np.full(n + 4096, MULT)
        POWERS[0] = 1
        POWERS = np.multiply.accumulate(POWERS)
    return POWERS[:n]


POWERS = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = np.asarray(h, np.uint64)
    h = np.multiply(h ^ (h >> np.uint64(31)), MIX)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words of each text)."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_chars()[points]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # polynomial in the offset inside the word, summed over each word
    offset = np.arange(len(points)) - np.repeat(begin, np.diff(np.r_[begin, len(points)]))[: len(points)] if begin[0] == 0 else None
    if offset is None:
        offset = np.arange(len(points)) - np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.r_[begin, len(points)]))])
    terms = np.where(inside, (points.astype(np.uint64) + np.uint64(1)) * _powers(int(offset.max()) + 1)[offset], np.uint64(0))
    h = mix(np.add.reduceat(terms, begin) + (end - begin).astype(np.uint64) * MIX)
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths), begin, "right")
    return h, np.bincount(owner, minlength=len(texts))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words (all words as one run, if fewer)."""
    if len(words) < size:
        return np.array([mix(np.bitwise_xor.reduce(words * _powers(len(words) + 1)[1:]) + np.uint64(len(words)))]) if len(words) else words
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = h * MULT + words[k : len(words) - size + 1 + k]
    return mix(h)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words as ``shingles`` has it: of five words, or of all words of a shorter text."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    if size == SHINGLE:
        return shingles(words)
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h ^= words[k : len(words) - size + 1 + k] * _powers(size + 1)[k + 1]
    return mix(h + np.uint64(size))


def _spread(width: int) -> np.ndarray:
    """For each group of bits (a byte, or four bits of it) the integer with one of them in each lane."""
    per = 64 // width
    v = np.arange(1 << per, dtype=np.uint64)
    return np.bitwise_or.reduce([((v >> np.uint64(k)) & np.uint64(1)) << np.uint64(k * width) for k in range(per)])


SPREAD = {8: _spread(8), 16: _spread(16)}


def running(words: np.ndarray, width: int) -> np.ndarray:
    """Running sums (from 0) of the bits of each hash as counters of ``width`` bits (8 or 16), packed in 64-bit integers (rows)."""
    per = 64 // width
    out = np.zeros((width, len(words) + 1), np.uint64)
    for r in range(width):
        np.cumsum(SPREAD[width][(words >> np.uint64(r * per)) & np.uint64((1 << per) - 1)], out=out[r, 1:])
    return out


def fingerprints(sums: np.ndarray, window: int, step: int, width: int) -> np.ndarray:
    """SimHash of the windows that begin at every multiple of ``step``, from running sums.

    A bit is set where most of the window's words have it.  Counters differ by
    less than a lane holds, so sums that ran over cancel.
    """
    ones = np.uint64(sum(1 << (width * k) for k in range(64 // width)))
    shift = ones * np.uint64((1 << (width - 1)) - (window // 2 + 1))  # a majority carries into a lane's top bit
    top = ones << np.uint64(width - 1)
    last = max(0, sums.shape[1] - window)  # fewer words than a window: none
    out = np.zeros(len(range(0, last, step)), np.uint64)
    for r in range(width):
        v = sums[r, window::step] - sums[r, :last:step]
        v += shift
        v &= top
        v >>= np.uint64(width - 1 - r)
        out |= v
    return out


#: Bits of a fingerprint's hash by which most windows that no item has are told.
SIEVE = 22

#: Short windows have at most as many words, so that counters of 8 bits hold them.
MOST_PART = 100


def _address(fp: np.ndarray) -> np.ndarray:
    return mix(fp) >> np.uint64(64 - SIEVE)

#: Steps divide this; documents are laid out at multiples of it, so that windows do not depend on the neighbours.
GRID = 12


class Items:
    """The items of a benchmark block, by class of length, with their multi-index."""

    def __init__(self, ids: list, texts: list[str], threshold: float, ratio: float = 1.12, radius: int = 7, blocks: int = 4):
        self.threshold, self.radius, self.blocks = threshold, radius, blocks
        h, n = word_hashes(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        ends = np.cumsum(n)
        self.words = [h[e - k : e] for e, k in zip(ends, n, strict=True)]
        self.lengths = n
        self.ids = ids
        self.grams = [np.unique(shingles(w), return_counts=True) for w in self.words]
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                groups.setdefault(int(np.log(len(w)) / np.log(ratio) + 1e-9), []).append(i)
        self.classes = []
        for members in (groups[k] for k in sorted(groups)):
            shortest = min(len(self.words[i]) for i in members)
            step = max(k for k in (1, 2, 3, 4, 6, 12) if k <= max(1, shortest // 8))
            window = shortest - step + 1
            width = 8 if window < 120 else 16
            fps, owner, offset = [], [], []
            for i in members:
                w = self.words[i]
                at = np.arange(len(w) - window + 1)
                fps.append(fingerprints(running(w, width), window, 1, width))
                owner.append(np.full(len(at), i))
                offset.append(at)
            fp, owner, offset = map(np.concatenate, (fps, owner, offset))
            self.classes.append({"window": window, "step": step, "width": width, "fp": fp, "owner": owner, "offset": offset, "index": self._index(fp)})
        self.parts = self._parts()

    def least(self, item: int) -> int:
        """Shingles that a stretch shares with an item at least, if it is similar enough."""
        return int(np.ceil(self.threshold * int(self.grams[item][1].sum()) - 1e-9))

    def run(self, item: int) -> int:
        """Words of the item that stand together, unchanged, in any stretch that is similar enough.

        A stretch has no more shingles than the item, and at most ``lost`` of
        them are not the item's, so those that are form at most ``lost + 1``
        runs.  Shingles that follow each other in a run overlap by all words but
        one, and so follow each other in the item too, unless it repeats such an
        overlap; then only a single shingle is certain.
        """
        words, size = self.words[item], min(len(self.words[item]), SHINGLE)
        least = self.least(item)
        lost = int(self.grams[item][1].sum()) - least
        overlaps = runs(words, size - 1) if size > 1 else words
        if len(np.unique(overlaps)) < len(overlaps):
            return size
        return size - 1 + -(-least // (lost + 1))

    def _parts(self) -> list[dict]:
        """For each pair of a short window's length and step: the sorted fingerprints of the items' windows, the item of each, and a sieve."""
        groups: dict[tuple[int, int], list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                size, run = min(len(w), SHINGLE), self.run(i)
                step = min(3, run - size + 1)
                groups.setdefault((min(run - step + 1, MOST_PART), step), []).append(i)
        out = []
        for (window, step), members in sorted(groups.items()):
            fps = [fingerprints(running(self.words[i], 8), window, 1, 8) for i in members]
            fp, owner = np.concatenate(fps), np.repeat(members, [len(f) for f in fps])
            order = np.lexsort((owner, fp))
            keys, first = np.unique(fp[order], return_index=True)
            sieve = np.zeros(1 << SIEVE, bool)
            sieve[_address(keys)] = True
            out.append({"window": window, "step": step, "keys": keys, "first": np.r_[first, len(fp)], "owner": owner[order], "sieve": sieve})
        return out

    def equal(self, part: dict, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose short windows have the same fingerprint."""
        keys, first = part["keys"], part["first"]
        at = np.flatnonzero(part["sieve"][_address(fp)])
        k = np.minimum(np.searchsorted(keys, fp[at]), len(keys) - 1)
        ok = keys[k] == fp[at]
        at, k = at[ok], k[ok]
        many = first[k + 1] - first[k]
        return np.repeat(at, many), part["owner"][np.repeat(first[k] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]

    def best(self, grams: np.ndarray, item: int) -> tuple[float, int, int] | None:
        """Similarity, first word and end of the stretch of a document that is most like an item, if it reaches the threshold.

        An occurrence of a shingle counts in the stretches that have it and not
        yet as many before it as the item has.
        """
        own, weight = self.grams[item]
        whole, n = int(weight.sum()), len(grams)
        k = np.minimum(np.searchsorted(own, grams), len(own) - 1)
        pos = np.flatnonzero(own[k] == grams)
        if len(pos) < self.least(item):
            return None
        order = np.argsort(k[pos], kind="stable")
        pos = pos[order]
        k = k[pos]
        back = np.arange(len(pos)) - weight[k]
        held = np.maximum(back, 0)
        before = np.where((back >= 0) & (k[held] == k), pos[held], -whole)
        since = np.maximum(before + 1, pos - whole + 1) + whole - 1
        both = np.cumsum(np.bincount(since, minlength=n + whole) - np.bincount(pos + whole, minlength=n + whole))[: n + whole - 1]
        a = np.arange(1 - whole, n)
        s = both / (whole + np.minimum(a + whole, n) - np.maximum(a, 0) - both)
        top = int(s.argmax())
        size = len(self.words[item])
        end = n + min(size, SHINGLE) - 1
        return (float(s[top]), max(int(a[top]), 0), min(int(a[top]) + size, end)) if s[top] >= self.threshold else None

    def _index(self, fp: np.ndarray) -> list:
        """For each block of bits: for every value, the fingerprints whose block is within radius // blocks bits."""
        bits = 64 // self.blocks
        flips = [0]
        for _ in range(self.radius // self.blocks):
            flips = sorted({f ^ (1 << b) for f in flips for b in range(bits)} | set(flips))
        flips = np.array(flips, np.uint64)
        out = []
        for k in range(self.blocks):
            part = (fp >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
            values = (part[:, None] ^ flips[None, :]).ravel()
            which = np.repeat(np.arange(len(fp)), len(flips))
            order = np.argsort(values, kind="stable")
            first = np.searchsorted(values[order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            out.append((first, which[order].astype(np.int32)))
        return out

    def near(self, c: dict, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) pairs within the radius: all of them, some more than once."""
        bits = 64 // self.blocks
        hits_w, hits_f = [], []
        for k, (first, which) in enumerate(c["index"]):
            part = ((fp >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            lo, hi = first[part], first[part + 1]
            at = np.flatnonzero(hi > lo)
            many = (hi - lo)[at].astype(np.int64)
            w = np.repeat(at, many)
            f = which[np.repeat(lo[at].astype(np.int64), many) + np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)]
            close = np.bitwise_count(fp[w] ^ c["fp"][f]) <= self.radius
            hits_w.append(w[close])
            hits_f.append(f[close])
        return np.concatenate(hits_w), np.concatenate(hits_f)

    def search(self, words: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(document, item, similarity, first word, end) of what is found in documents laid end to end."""
        begins = np.cumsum(-(-n // GRID) * GRID) - (-(-n // GRID) * GRID)
        laid = np.zeros(int((-(-n // GRID) * GRID).sum()), np.uint64)
        laid[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(len(words))] = words
        sums: dict[int, np.ndarray] = {8: running(laid, 8)}
        some = [np.zeros(0, np.int64)]
        for c in self.classes:
            if c["width"] not in sums:
                sums[c["width"]] = running(laid, c["width"])
            fp = fingerprints(sums[c["width"]], c["window"], c["step"], c["width"])
            w, f = self.near(c, fp)
            item = c["owner"][f]
            at = np.maximum(w * c["step"] - c["offset"][f], 0)
            doc = np.searchsorted(begins, at + self.lengths[item] // 2, "right") - 1
            some.append(np.unique(doc * len(self.words) + item))
        for p in self.parts:
            w, item = self.equal(p, fingerprints(sums[8], p["window"], p["step"], 8))
            doc = np.searchsorted(begins, w * p["step"], "right") - 1
            some.append(np.unique(doc * len(self.words) + item))
        pairs, ends, found = np.unique(np.concatenate(some)), np.cumsum(n), []
        sizes = np.minimum(self.lengths[pairs % len(self.words)], SHINGLE)
        for size in np.unique(sizes).tolist():
            hashes = runs(words, size)
            for pair in pairs[sizes == size].tolist():
                doc, item = divmod(pair, len(self.words))
                best = self.best(hashes[ends[doc] - n[doc] : max(ends[doc] - size + 1, ends[doc] - n[doc])], item)
                if best:
                    found.append((doc, item, *best))
        return sorted(found)


def blocks_of_items(benchmark: DataFrame, most_words: int) -> list[tuple[list, list[str]]]:
    """The benchmark in blocks of at most about ``most_words`` words (at most 6 bytes each as text), one in memory at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.length("text") / 6)).first()[0] or 0
    n = max(1, int(-(-total // most_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = items.where(part == k).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, most_words: int = 500_000, batch_bytes: int = 1 << 19) -> DataFrame:
    """(doc_id, th, item_id, similarity, first_word, end_word): the benchmark items that documents contain.

    The items of a block are shipped to every executor; their number is bounded
    by ``most_words``, and a larger benchmark is taken in as many passes.
    """
    out = None
    for ids, texts in blocks_of_items(benchmark, most_words):
        shipped = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, threshold))

        def run(batches, shipped=shipped):
            items = shipped.value
            for b in arrow_batches(batches, batch_bytes):
                texts = [t or "" for t in b.column(1).to_pylist()]
                words, n = word_hashes(texts)
                got = items.search(words, n) if len(words) and items.classes else []
                if got:
                    rows = pa.array([g[0] for g in got])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), b.column(2).take(rows), pa.array([items.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got]), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())],
                        ["doc_id", "th", "item_id", "similarity", "first_word", "end_word"],
                    )

        part = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, item_id long, similarity double, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, most_words: int = 500_000, batch_bytes: int = 1 << 19) -> DataFrame:
    """The rows and columns of ``docs`` without those that contain a benchmark item; one pass a block of items."""
    at = docs.columns.index("text")
    for ids, texts in blocks_of_items(benchmark, most_words):
        shipped = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, threshold))

        def run(batches, shipped=shipped):
            items = shipped.value
            for b in arrow_batches(batches, batch_bytes):
                words, n = word_hashes([t or "" for t in b.column(at).to_pylist()])
                got = items.search(words, n) if len(words) and items.classes else []
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in got]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity", "first_word", "end_word")
