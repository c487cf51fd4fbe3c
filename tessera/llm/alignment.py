"""Alignment of the tokens of two tokenizers by cogrouped postings.

Each text, with a space in front, is encoded by a byte-level BPE (A) and by a
SentencePiece BPE (B).  Byte offsets where tokens of both end cut the text into
groups; every A token of a group is linked with every B token of it.  How many
documents link two ids is a count of the whole corpus.

* Per-document pair multiplicities are written once, packed by document.
* Counts are summed before they are shuffled, (a, b, documents), at most one row
  a pair of ids.
* Postings (a, document, b, multiplicity) and counts are shuffled together by
  side id A and sorted by (a, document): Spark's sort spills, and as the counts
  of an id come before its postings, a task holds one id's counts at a time (at
  most the vocabulary of B) and streams the rest.  It finds the id's highest
  count, and gives each document's share in one row per id.
* Ids with very many postings are dealt over several tasks, which all get the
  id's counts.  How many is told from the counts, one number an id of A.
* Shares are summed by document.

Definitions:

* Special tokens' strings inside texts are plain text.
* Null and empty texts, and texts whose joined token bytes of either side are not
  the space and the text, have no tokens: zeros and ''.
* Ties: every B id whose count is its A id's highest is a best one.
* Every row is a document: repeated rows count as often as they come, and null
  and repeated ids do not matter.  Texts of any length are encoded whole.
* An empty table gives an empty result.  Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, table

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the public byte-level BPE's word pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANK = re.compile(r"\s{5000}")
DOCS = "ref long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
SALTS = 20  # bits of a posting's key that say which of an id's tasks it goes to


class Sides:
    """Both encoders and the bytes of their tokens; made from the files' contents, once a worker."""

    _held: dict[bytes, Sides] = {}

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        self.a_file = a_file
        known = json.loads(a_file)
        special = {t["id"] for t in known["added_tokens"]}
        byte_of = self._byte_letters()
        self.a_bytes = [b""] * (max(known["model"]["vocab"].values()) + 1)
        for token, i in known["model"]["vocab"].items():
            if i not in special:
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
        # ids of this kind of file are in the order of its merges, so that they are ranks too
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if b}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (np.array([f"{i}," for i in range(len(x))] + [f"{i}{end}" for i in range(len(x))], object) for x, end in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        self._slow = None

    @staticmethod
    def _byte_letters() -> dict[str, int]:
        """The letter that stands for each byte: itself if it is printable, else one from U+0100 on."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}

    @classmethod
    def of(cls, a_file: bytes, b_file: bytes) -> Sides:
        key = hashlib.sha256(a_file + b_file).digest()
        if key not in cls._held:
            cls._held[key] = cls(a_file, b_file)
        return cls._held[key]

    def encode_a(self, text: str) -> list[int]:
        if len(text) >= 5000 and LONG_BLANK.search(text):  # the fast encoder's pattern overflows its stack there
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_str(self.a_file.decode())
                self._slow.encode_special_tokens = True
            return self._slow.encode(text, add_special_tokens=False).ids
        return self.a.encode_ordinary(text)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where the joined bytes of either are not the space and the text."""
        b = self.b.encode([t or "" for t in texts], num_threads=1)
        out = []
        for t, ib in zip(texts, b, strict=True):
            ia, want = (self.encode_a(" " + t), b" " + t.encode()) if t else ([], b"")
            same = t and b"".join([self.a_bytes[i] for i in ia]) == want and b"".join([self.b_bytes[i] for i in ib]) == want
            out.append((ia, ib) if same else ([], []))
        return out


def _linked(ia: np.ndarray, ib: np.ndarray, ga: np.ndarray, gb: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray, large: int = 1 << 14) -> tuple[np.ndarray, ...]:
    """(document, a, b, times) of all links, sorted and summed; tokens are given by side with their groups, groups with their sizes and documents."""
    big = na * nb > large
    one = ~big[ga]
    n = np.where(one, nb[ga], 0)
    start = np.cumsum(nb) - nb
    at = np.repeat(np.arange(len(ia)), n)
    other = np.repeat(start[ga], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    d, a, b, m = [doc[ga[at]]], [ia[at]], [ib[other]], [np.ones(len(at), np.int64)]
    first = np.cumsum(na) - na
    for g in np.flatnonzero(big):  # long groups by distinct ids, not by tokens
        (ua, ca), (ub, cb) = (np.unique(x, return_counts=True) for x in (ia[first[g] : first[g] + na[g]], ib[start[g] : start[g] + nb[g]]))
        d.append(np.full(len(ua) * len(ub), doc[g]))
        a.append(np.repeat(ua, len(ub)))
        b.append(np.tile(ub, len(ua)))
        m.append(np.outer(ca, cb).ravel())
    d, a, b, m = map(np.concatenate, (d, a, b, m))
    order = np.lexsort((b, a, d)) if max(a.max(initial=0), b.max(initial=0)) >= 1 << 20 else np.argsort((d << 40) | (a << 20) | b, kind="stable")
    d, a, b, m = d[order], a[order], b[order], m[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(d)])
    return d[new], a[new], b[new], np.add.reduceat(m, new) if len(new) else m


def aligned(sides: Sides, texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, pairs) of each text; pairs packed."""
    ids = sides.encode(texts)
    size_a, size_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    ia, ib = (np.array([i for x in ids for i in x[k]], np.int64) for k in (0, 1))
    end_a, end_b = np.cumsum(sides.a_size[ia]), np.cumsum(sides.b_size[ib])
    total = int(end_a[-1]) if len(end_a) else 0
    mark_a, mark_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    mark_a[end_a], mark_b[end_b] = True, True
    cut_a, cut_b = mark_b[end_a], mark_a[end_b]  # last tokens of groups; texts end on both sides, so groups never span two
    ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    groups = int(cut_a.sum())
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    doc = np.repeat(np.arange(len(ids)), size_a)[cut_a]
    n_groups, n_links = (np.bincount(doc, weights=w, minlength=len(ids)).astype(np.int64) for w in (None, na * nb))
    parts = np.empty(len(ia) + len(ib), object)
    parts[np.arange(len(ia)) + (np.cumsum(nb) - nb)[ga]] = sides.a_text[ia + len(sides.a_bytes) * cut_a]
    parts[np.arange(len(ib)) + np.cumsum(na)[gb]] = sides.b_text[ib + len(sides.b_bytes) * cut_b]
    d, a, b, m = _linked(ia, ib, ga, gb, na, nb, doc)
    edge = np.searchsorted(d, np.arange(len(ids) + 1))
    ends = np.cumsum(size_a + size_b)
    return [
        (int(size_a[k]), int(size_b[k]), int(n_groups[k]), int(n_links[k]), "".join(parts[ends[k] - size_a[k] - size_b[k] : ends[k]])[:-1], _pack(*(x[edge[k] : edge[k + 1]] for x in (a, b, m))))
        for k in range(len(ids))
    ]


def _encode(a_file, b_file):
    def run(batches):
        sides = Sides.of(a_file.value, b_file.value)
        for batch in arrow_batches(batches, 2 << 20):
            got = aligned(sides, batch.column(2).to_pylist())
            columns = [pa.array([g[k] for g in got], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(g[4].encode()).hexdigest() if g[0] else "" for g in got], pa.string())
            pairs = pa.array([g[5] for g in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, sha, pairs], ["ref", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return run


def _pack(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> bytes:
    """Pairs and their multiplicities as one value, 16 bytes a pair."""
    return a.astype(np.int32).tobytes() + b.astype(np.int32).tobytes() + m.astype(np.int64).tobytes()


def _rows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, times of packed pairs."""
    n = len(raw) // 16
    return np.frombuffer(raw, np.int32, n).astype(np.int64), np.frombuffer(raw, np.int32, n, 4 * n).astype(np.int64), np.frombuffer(raw, np.int64, n, 8 * n)


def _partial_counts(batches):
    """(ab, n): of how many documents of the task each pair of ids is one, summed whenever 2,000,000 pairs have come."""
    names = ["ab", "n"]

    def summed(parts):
        ab, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ab), pa.array(n.astype(np.int64))], names)

    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            a, b, _ = _rows(raw)
            held.append((a << 32) | b)
            size += len(held[-1])
            if size > 2_000_000:
                yield summed(held)
                held, size = [], 0
    if held:
        yield summed(held)


def _postings(salts):
    """(k, b, r, m): an id of A with the task it goes to, an id of B, a document, and how often the document links them."""

    def run(batches):
        spread = salts.value
        for batch in batches:
            out = []
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b, m = _rows(raw)
                salt = (r * 0x9E3779B1 & 0xFFFFFFFF) % spread[a] if len(a) else a
                out.append(np.stack([(a << SALTS) | salt, b, np.full(len(a), r), m]))
            at = np.concatenate(out, axis=1)
            for lo in range(0, at.shape[1], 100_000):
                piece = at[:, lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in piece], ["k", "b", "r", "m"])

    return run


def _shares(batches):
    """(r, best, sum): each document's links of an id whose count is the id's highest, and the sum of its links' counts.

    Rows come sorted by (k, r, b): an id's counts (r = -1) first.
    """
    now, counts, ids, most = None, None, None, 0
    pending: list[np.ndarray] = []
    for batch in batches:
        k, b, r, m = (batch.column(i).to_numpy() for i in range(4))
        if not len(k):
            continue
        out = []
        edges = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if k[lo] != now:
                now, counts, pending = k[lo], None, []
            split = lo + int(np.searchsorted(r[lo:hi], 0))
            if split > lo:
                pending.append(np.stack([b[lo:split], m[lo:split]]))
            if split == hi:
                continue
            if counts is None:
                ids, counts = np.concatenate(pending, axis=1)
                most, pending = counts.max(), []
            c, times, doc = counts[np.searchsorted(ids, b[split:hi])], m[split:hi], r[split:hi]
            new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out.append(np.stack([doc[new], np.add.reduceat(times * (c == most), new), np.add.reduceat(times * c, new)]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], ["r", "best", "sum"])


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Documents (ref, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and counts (a, b, documents).

    ``rows``: postings a task is meant to have.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        files = sc.broadcast(f.read()), sc.broadcast(g.read())  # vocabularies, a few MB
    texts = docs.select(F.monotonically_increasing_id().alias("ref"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = materialise(texts.mapInArrow(_encode(*files), DOCS), "aligned", "zstd")
    counts = held.select("pairs").mapInArrow(_partial_counts, "ab long, n long").groupBy("ab").agg(F.sum("n").alias("n"))
    counts = materialise(counts.select(F.shiftright("ab", 32).alias("a"), F.col("ab").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n"), "counts", "zstd")
    by_id = counts.groupBy("a").agg(F.sum("n").alias("n")).collect()  # one number an id of A
    total = sum(x["n"] for x in by_id)
    parts = min(max(total // rows + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1 << 15)
    spread = np.ones(max([x["a"] for x in by_id], default=0) + 1, np.int64)
    for x in by_id:
        spread[x["a"]] = min(4 * parts * x["n"] // total + 1, (1 << SALTS) - 1)
    salts = sc.broadcast(spread)
    postings = held.select("ref", "pairs").mapInArrow(_postings(salts), "k long, b long, r long, m long")
    spread_rows = spark.createDataFrame([(x["a"], int(spread[x["a"]])) for x in by_id if spread[x["a"]] > 1], "a long, tasks long")  # ids with more than a quarter of a task
    heads = counts.join(F.broadcast(spread_rows), "a", "left").select(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tasks", F.lit(1).cast("long")) - 1)).alias("salt"), "a", "b", "n")
    heads = heads.select(F.shiftleft("a", SALTS).bitwiseOR(F.col("salt")).alias("k"), "b", F.lit(-1).cast("long").alias("r"), F.col("n").alias("m"))
    stream = postings.unionByName(heads).repartition(parts, "k").sortWithinPartitions("k", "r", "b")
    sums = stream.mapInArrow(_shares, "r long, best long, sum long").groupBy(F.col("r").alias("ref")).agg(F.sum("best").alias("n_best"), F.sum("sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = held.drop("pairs").join(sums, "ref", "left").select("ref", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return out, counts.withColumnRenamed("n", "documents")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))[0].drop("ref")
