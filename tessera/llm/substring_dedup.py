"""Removal of long repeated byte strings, with suffix arrays by induced sorting.

A window is a string of ``length`` bytes.  Windows have a minimizer, the smallest
hash of their 24-byte strings; a region is a run of windows of a document with
one minimizer.  Minimizers that come once in the corpus are done: which come
twice is found from five bytes of each.  The other regions are cut by how far
their windows begin before the minimizer (the same distance in equal windows),
so that a piece's windows share one long string; its hash is the piece's key,
and equal windows always meet under one key, however common their minimizer is.
Pieces with the same bytes are counted before anything moves: one of each is
kept, and all the windows of those that occur twice are repeated.  The bytes of
the pieces whose key has different ones, one of each text, go to the key's shard
and are sorted there:

* suffixes are classified as smaller or larger than the next one;
* leftmost-smaller substrings are sorted by one induced pass, named, and the
  string of names is sorted in turn: recursively while its alphabet is small,
  else by doubling prefixes, which suits arrays better than tiny buckets;
* the shard's array is induced from them, whole buckets at a time: a bucket's
  entries are taken in waves, each wave one array operation;
* permuted common prefixes with the predecessor in the array, up to the
  window's length, by bisection over hashes of prefixes.

A window is repeated if it has such a prefix of full length with a neighbour.

Definitions: text counts as its UTF-8 bytes, null as none; matches never cross
documents; every byte that a repeated window covers is removed, judged on the
input.  Rows that repeat are other places: their windows count as repeated.
Texts shorter than a window keep all.  Each row of the input gives a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, held, in_sieve, join_hot, materialise, row_key, same, sieve, sieve_bits, table
from .short_keys import SHORT, dealt, shard_bits, short

GRAM = 24
BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
LUT = np.random.default_rng(20240229).integers(1, 2**63, 257, dtype=np.uint64) | np.uint64(1)
PLACE = 28  # bits of a position in a batch


def _powers(base: np.uint64, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006  one array a process
    if base not in held or len(held[base]) < n:
        p = np.full(n + n // 4 + 1024, base)
        p[0] = 1
        held[base] = np.multiply.accumulate(p)
    return held[base][:n]


class Hashes:
    """Hashes of all substrings of a sequence of symbols under 257, by running sums modulo 2**64."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(LUT[symbols] * _powers(BASE, len(symbols)), out=self.sums[1:])
        self.back = _powers(INVERSE, len(symbols) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def minimizers(data: bytes, window: int) -> np.ndarray:
    """For each window of ``window`` bytes the position of its smallest 24-byte string (the leftmost of equals)."""
    n = len(data) - 7
    word = np.ndarray((n,), "<u8", data, 0, (1,))
    m = n - GRAM + 8
    h = word[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8 : m + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += word[16 : m + 16]
    h *= np.uint64(0x94D049BB133111EB)
    h &= ~np.uint64((1 << PLACE) - 1)
    h |= np.arange(m, dtype=np.uint64)
    w = window - GRAM + 1
    full = -(-m // w) * w
    a = np.full(full, np.uint64(2**64 - 1))
    a[:m] = h
    rows = a.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    return (best & np.uint64((1 << PLACE) - 1)).astype(np.int64)


class Windows:
    """The windows of some texts laid end to end, and their minimizers."""

    def __init__(self, texts: list[bytes], window: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.window, self.data = window, b"".join(texts)
        self.begin = np.cumsum(sizes) - sizes
        self.end = self.begin + sizes
        self.at = minimizers(self.data, window) if len(self.data) >= window else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(texts)), sizes)[: len(self.at)]
        self.hash = Hashes(np.frombuffer(self.data, np.uint8))

    def regions(self) -> tuple[np.ndarray, ...]:
        """(first window, windows, minimizer) of each run of windows of a text with one minimizer."""
        at, owner = self.at, self.owner
        if not len(at):
            return (at,) * 3
        inside = np.arange(len(at)) + self.window <= self.end[owner]
        new = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]
        first = np.flatnonzero(new & inside)
        # a region ends where the next begins, or with the last window of its text
        nxt = np.r_[np.flatnonzero(new), len(at)]
        stop = np.minimum(nxt[np.searchsorted(nxt, first, "right")], (self.end - self.window + 1)[owner[first]])
        return first, stop - first, at[first]

    def grams(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the 24-byte strings at ``at``."""
        return self.hash.of(at, at + GRAM)

    def cut(self, first: np.ndarray, many: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
        """(first window, windows, key, hash of the bytes) of regions, cut by how far windows begin before their minimizer.

        The distance and so its class of ``step`` is the same for equal windows;
        the key is the hash of the string that all windows of the class share.
        """
        high, low = (at - first) // step, (at - first - many + 1) // step
        pieces = high - low + 1
        row = np.repeat(np.arange(len(first)), pieces)
        level = high[row] - (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        core = at[row] - level * step
        start = np.maximum(first[row], core - step + 1)
        stop = np.minimum((first + many)[row], core + 1)
        key = self.hash.of(core, core - step + 1 + self.window) * INVERSE + level.astype(np.uint64)
        return start, stop - start, key ^ (key >> np.uint64(31)), self.hash.of(start, stop + self.window - 1)

    def probes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the distinct strings of ``size`` bytes that begin at minimizers."""
        first, _, at = self.regions()
        ok = at + size <= self.end[self.owner[first]]
        got = np.unique(np.array([self.owner[first[ok]], self.hash.of(at[ok], at[ok] + size).view(np.int64)]), axis=1)
        key = got[1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return got[0], key ^ (key >> np.uint64(29))


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol is the smallest and alone."""
    up = np.zeros(len(s), bool)
    up[-1] = True
    d = np.sign(s[1:].astype(np.int64) - s[:-1])
    decided = np.flatnonzero(d)
    nxt = decided[np.minimum(np.searchsorted(decided, np.arange(len(d))), len(decided) - 1)]
    up[:-1] = d[nxt] > 0
    return up


def _stable(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys, kind="stable")


def _induce(s: np.ndarray, up: np.ndarray, lms: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix array induced from the order of the leftmost-smaller suffixes ``lms``."""
    n = len(s)
    counts = np.bincount(s, minlength=n_symbols)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(n, -1, np.int64)
    lms_count = np.bincount(s[lms], minlength=n_symbols)
    order = lms[_stable(s[lms])]
    lms_end = np.cumsum(lms_count)
    present = np.flatnonzero(counts)
    front = heads.copy()
    for c in present.tolist():  # larger suffixes, from the left
        done = heads[c]
        waves = True
        while waves:
            got = sa[done : front[c]]
            done = front[c]
            waves = len(got) > 0
            _push(s, up, sa, got, front, False, 1)
        _push(s, up, sa, order[lms_end[c] - lms_count[c] : lms_end[c]], front, False, 1)
    back = ends.copy()
    for c in present[::-1].tolist():  # smaller suffixes, from the right
        done = ends[c]
        waves = True
        while waves:
            got = sa[back[c] : done][::-1]
            done = back[c]
            waves = len(got) > 0
            _push(s, up, sa, got, back, True, -1)
        _push(s, up, sa, sa[heads[c] : front[c]][::-1], back, True, -1)
    sa[0] = n - 1
    return sa


def _push(s, up, sa, got, edge, kind, way) -> None:
    """Put the predecessors of ``got`` of type ``kind`` at the edges of their buckets, in order."""
    q = got[got > 0] - 1
    q = q[up[q] == kind]
    if not len(q):
        return
    k = s[q]
    o = _stable(k)
    k, q = k[o], q[o]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[first, len(k)])
    rank = np.arange(len(k)) - np.repeat(first, size)
    if way > 0:
        sa[edge[k] + rank] = q
    else:
        sa[edge[k] - 1 - rank] = q
    edge[k[first]] += way * size


def _doubling(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array to ``depth`` symbols at least, by doubling prefixes."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, k = len(s), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        sa = _stable(key)
        ordered = key[sa]
        fresh = np.empty(n, np.int64)
        fresh[sa] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank, k = fresh, 2 * k
        if rank[sa[-1]] == n - 1 or k >= min(depth, n):
            return sa


def suffix_array(s: np.ndarray, n_symbols: int, depth: int) -> np.ndarray:
    """Suffix array of symbols that end with a 0 found nowhere else, right to ``depth`` symbols at least."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    s = s.astype(np.uint16 if n_symbols <= 65536 else np.int64)
    up = _types(s)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    sa = _induce(s, up, lms, n_symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    # name the substrings from each to the next: equal ones have equal hashes and lengths
    nxt = np.r_[lms[1:], n - 1]
    size = np.zeros(n, np.int64)
    size[lms] = nxt - lms
    sums = np.zeros(n + 1, np.uint64)
    symbol = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    symbol ^= symbol >> np.uint64(31)
    np.cumsum((symbol | np.uint64(1)) * _powers(BASE, n), out=sums[1:])
    stop = np.minimum(ordered + size[ordered] + 1, n)
    print_ = (sums[stop] - sums[ordered]) * _powers(INVERSE, n + 1)[ordered]
    name = np.zeros(n, np.int64)
    name[ordered] = np.cumsum(np.r_[0, (print_[1:] != print_[:-1]) | (size[ordered][1:] != size[ordered][:-1])])
    reduced = name[lms]
    names = int(reduced.max()) + 1
    if names == len(lms):
        below = np.empty(len(lms), np.int64)
        below[reduced] = np.arange(len(lms))
    elif names <= 512 and (reduced == reduced[-1]).sum() == 1:
        below = suffix_array(reduced, names, depth // 2 + 1)
    else:
        below = _doubling(reduced, depth // 2 + 1)
    return _induce(s, up, lms[below], n_symbols)


def common_prefixes(sa: np.ndarray, h: Hashes, wanted: np.ndarray, most: int, n: int) -> np.ndarray:
    """For each position of ``wanted`` its common prefix with its predecessor in the array, ``most`` at most."""
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    a, b = wanted, phi[wanted]
    low, high = np.zeros(len(a), np.int64), np.where(b < 0, 0, np.minimum(most, n - np.maximum(a, b)))
    while (low < high).any():
        mid = (low + high + 1) // 2
        equal = h.of(a, a + mid) == h.of(np.maximum(b, 0), np.maximum(b, 0) + mid)
        low, high = np.where(equal & (low < high), mid, low), np.where(equal | (low >= high), high, mid - 1)
    return low


def repeated(texts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each region (its bytes and number of windows) which of its windows occur in another place of the shard."""
    symbols = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.uint16) + 2
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    seams = (begin + sizes)[:-1]
    symbols = np.append(symbols, np.uint16(0))  # the end; 1 is a seam, which no window spans
    symbols[seams] = 1
    sa = suffix_array(symbols, 258, length + 1)
    many = np.array(windows, np.int64)
    at = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    h = Hashes(np.minimum(symbols, 256))
    full = np.zeros(len(symbols) + 1, bool)
    deep = common_prefixes(sa, h, at, length, len(symbols)) >= length
    phi = np.full(len(symbols), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    full[at[deep]] = True
    full[phi[at[deep]]] = True  # the neighbour before it has the same window
    return [full[b : b + m] for b, m in zip(begin.tolist(), windows, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _raw(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def shared_keys(docs: DataFrame, length: int, probe: int, spacing: int, batch_bytes: int) -> DataFrame:
    """(key): minimizers of windows that come twice or more, and probes of two texts or more, by their first 40 bits.

    Keys move as five bytes, at most two of each a batch.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = shard_bits(4 * size // spacing)

    def deal(batches):
        for b in arrow_batches(batches, batch_bytes, "text"):
            texts = _raw(b.column(0))
            w = Windows(texts, length)
            every = np.sort(short(np.concatenate([w.grams(w.regions()[2]), Windows(texts, GRAM + spacing - 1).probes(probe)[1]])))
            third = np.r_[False, False, every[2:] == every[:-2]] if len(every) > 1 else np.zeros(len(every), bool)
            shard, low = dealt(every[~third], bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(low, pa.binary())], ["shard", "low"])

    def meet(t: pa.Table) -> pa.Table:
        low = np.sort(np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint32))
        twice = np.unique(low[1:][low[1:] == low[:-1]])
        key = (np.uint64(t.column("shard")[0].as_py()) << np.uint64(SHORT - bits)) + twice
        return pa.table({"key": pa.array((key << np.uint64(64 - SHORT)).view(np.int64))})

    return docs.select("text").mapInArrow(deal, "shard int, low binary").groupBy("shard").applyInArrow(meet, "key long")


def _regions(docs: DataFrame, length: int, probe: int, spacing: int, step: int, kept: np.ndarray, batch_bytes: int) -> DataFrame:
    """(doc_id, th, start, windows, key, content) of the cut regions, and of the probes (no windows), whose keys may be shared."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        bits = shipped.value
        for b in arrow_batches(batches, batch_bytes):
            texts = _raw(b.column(1))
            w = Windows(texts, length)
            first, many, at = w.regions()
            ok = held(bits, w.grams(at))
            start, windows, key, content = w.cut(first[ok], many[ok], at[ok], step)
            who, probes = Windows(texts, GRAM + spacing - 1).probes(probe)
            ok = held(bits, probes)
            owner = np.r_[w.owner[start], who[ok]]
            zero = np.zeros(int(ok.sum()), np.int32)
            rows = pa.array(owner)
            columns = [np.r_[(start - w.begin[w.owner[start]]).astype(np.int32), zero], np.r_[windows.astype(np.int32), zero], np.r_[key, probes[ok]].view(np.int64), np.r_[content, probes[ok]].view(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), *map(pa.array, columns)], ["doc_id", "th", "start", "windows", "key", "content"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, start int, windows int, key long, content long")


def _with_texts(docs: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """``docs`` (doc_id, text) joined with ``few`` (doc_id, th, at): rows (doc_id, text, at), only texts that may have a partner moved; left: all others too."""
    few = few.withColumn("row", F.xxhash64("doc_id", "th"))
    keyed = in_sieve(docs.select("text", *row_key()).withColumn("row", F.xxhash64("doc_id", "th")), "row", sieve(few, "row"))
    near = keyed.where("_in").alias("d").join(few.alias("f"), same("d", "f", "doc_id", "th", "row"), how).select("d.doc_id", "d.th", "d.text", "f.at")
    return near if how == "inner" else near.unionByName(keyed.where("not _in").select("doc_id", "th", "text", F.lit(None).cast(few.schema["at"].dataType).alias("at")))


def _cut(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The bytes of the regions in ``places`` (doc_id, th, start, windows, key, content)."""
    lists = materialise(places.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows", "key", "content")).alias("at")), "places")
    keyed = _with_texts(docs, lists, "inner").dropDuplicates(["doc_id", "th"]).select("text", "at")

    def run(batches):
        for b in arrow_batches(batches, 4 << 20):
            for text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"] for r in at]), pa.array([r["content"] for r in at]), pa.array([r["windows"] for r in at], pa.int32()), pa.array([data[r["start"] : r["start"] + r["windows"] + length - 1] for r in at], pa.binary())],
                    ["key", "content", "windows", "data"],
                )

    return keyed.mapInArrow(run, "key long, content long, windows int, data binary")


RUNS = "array<struct<lo:int,hi:int>>"


def _sorted_shards(pieces: DataFrame, length: int, shards: int) -> DataFrame:
    """(key, content, runs): the runs of repeated windows of each region, one induced sort a shard."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(t: pa.Table) -> pa.Table:
        flags = repeated(t.column("data").to_pylist(), t.column("windows").to_pylist(), length)
        runs = [[{"lo": a, "hi": b} for a, b in _runs(f)] for f in flags]
        return pa.table({"key": t.column("key"), "content": t.column("content"), "runs": pa.array(runs, kind)})

    return pieces.withColumn("shard", F.pmod(F.col("key"), F.lit(shards))).groupBy("shard").applyInArrow(run, f"key long, content long, runs {RUNS}")


def spans(docs: DataFrame, length: int = 400, probe: int = 160, spacing: int = 77, step: int = 128, shard_bytes: int = 1 << 20, batch_bytes: int = 1 << 20, large: int = 1000) -> DataFrame:
    """(doc_id, th, at: struct of runs and shared) of each document that has some.

    runs: the starts of repeated windows; shared: how many of its strings of
    ``probe`` bytes at minimizers other texts have too.  Any passage of
    ``probe + spacing`` bytes that two documents share has such a string.  Values
    with over ``large`` rows are dealt over tasks.
    """
    kept = sieve_bits(sieve(shared_keys(docs, length, probe, spacing, batch_bytes), "key"))
    every = materialise(_regions(docs, length, probe, spacing, min(step, length - 1), kept, batch_bytes).withColumn("both", F.xxhash64("key", "content")), "regions")
    texts = every.groupBy("key", "content", "both").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "th", "start", "windows")).alias("one"))
    texts = materialise(texts, "texts")
    keys = texts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    mixed = materialise(keys.where("kinds > 1"), "mixed")
    several = materialise(join_hot(texts.where("one.windows > 0"), mixed, "key", mixed.where(F.col("kinds") > large), ["content"]), "several")
    places = several.select("one.*", "key", "content", "both")
    size = places.agg(F.sum(F.col("windows") + length)).first()[0] or 0
    found = _sorted_shards(_cut(docs, places, length), length, max(1, int(-(-size // shard_bytes)))).withColumn("both", F.xxhash64("key", "content"))
    found = found.where(F.size("runs") > 0).select("both", "runs")
    again = texts.where("m > 1")
    whole = again.select("both", F.array(F.struct(F.lit(0).alias("lo"), F.col("one.windows").alias("hi"))).cast(RUNS).alias("runs"), "m")
    found = found.join(whole.select("both"), "both", "left_anti").withColumn("m", F.lit(1).cast("long")).unionByName(whole)
    found = materialise(found, "runs")
    shifted = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("start")).alias("lo"), (r["hi"] + F.col("start")).alias("hi")))
    hits = join_hot(every, found, "both", found.where(F.col("m") > large), ["doc_id", "th", "start"])
    hits = hits.select("doc_id", "th", F.when(F.col("windows") > 0, shifted).alias("runs"), (F.col("windows") == 0).cast("long").alias("shared"))
    found = hits.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.sum("shared").alias("shared"))
    return found.select("doc_id", "th", F.struct("runs", "shared").alias("at"))


def removed(docs: DataFrame, length: int = 400, **how) -> DataFrame:
    """doc_id, kept (binary), kept_sha256, n_bytes, n_removed, n_spans, n_shared of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = materialise(spans(docs, length, **how), "spans")
    joined = _with_texts(docs, found, "left").select("doc_id", "text", "at.runs", F.coalesce("at.shared", F.lit(0).cast("long")).alias("shared"))

    def run(batches):
        for b in arrow_batches(batches, 4 << 20):
            kept, n, gone, many = [], [], [], []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                cover = []
                for lo, hi in sorted((r["lo"], r["hi"] + length - 1) for r in runs or ()):
                    if cover and lo <= cover[-1][1]:
                        cover[-1][1] = max(cover[-1][1], hi)
                    else:
                        cover.append([lo, hi])
                rest, at = [], 0
                for lo, hi in cover:
                    rest.append(data[at:lo])
                    at = hi
                rest.append(data[at:])
                kept.append(b"".join(rest))
                n.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                many.append(len(cover))
            columns = [pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), *[pa.array(x, pa.int64()) for x in (n, gone, many)], b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "kept", "kept_sha256", "n_bytes", "n_removed", "n_spans", "n_shared"])

    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, kept_sha256 string, n_bytes long, n_removed long, n_spans long, n_shared long")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
