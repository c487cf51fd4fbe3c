"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and indexed by a suffix array
that is sorted as deep as the longest piece.  Every piece of the model is looked
up by binary search, which gives the range of its occurrences; the occurrences
are edges (position, length, piece), put in order of position.  The edges are
then relaxed: in each round the best edge that joins two neighbouring symbols of
a word is taken, the leftmost of equals, until no edge joins two symbols.  That
is the merge order of the model's byte-pair encoding, so the pieces are those of
the public implementation.

Definitions:

* Text is taken as it is but for a space in front and U+2581 for each space.
  No piece of the model crosses from a word into the next space, so a word with
  the spaces before it is encoded alone.
* Characters outside the model become their UTF-8 bytes.  Control pieces in the
  text are ordinary text.
* Null text gives null ids; empty text gives no ids.
* Decoding joins the pieces and drops the space in front.  ``round_trip`` says
  whether that gives the text again (a text that holds U+2581 itself does not).
* Each row of the input gives a row.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NO = np.int32(2**31 - 1)
LONG = 64  # characters beyond which a word is merged with a heap


class Pieces:
    """A model's pieces: strings, ranks (0 first) and the ids of the bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.raw = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in plain])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        order = sorted(range(len(plain)), key=lambda k: self.raw[plain[k]])
        self.ids = np.array([plain[k] for k in order], np.int32)
        self.strings = [self.raw[i] for i in self.ids]
        self.ranks = rank[order]
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes = []
        for i, s in enumerate(self.raw):
            if sp.is_byte(i):
                self.byte_ids[int(s[1:-1], 16)] = i
                self.bytes.append(bytes([int(s[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(s.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.strings))
        self.id_rank = np.full(n, NO)
        self.id_rank[self.ids] = self.ranks


def suffix_keys(points: np.ndarray, alphabet: np.ndarray, depth: int) -> np.ndarray:
    """For each position (column) its next ``depth`` characters, packed into a few words; 0 is past the end."""
    codes = np.searchsorted(alphabet, points).astype(np.uint64) + 1
    bits = max(1, int(len(alphabet) + 1).bit_length())
    each = 64 // bits
    codes = np.r_[codes, np.zeros(depth + each, np.uint64)]
    n = len(points)
    keys = []
    for k in range(0, depth, each):
        key = np.zeros(n, np.uint64)
        for j in range(k, k + each):
            key = (key << np.uint64(bits)) | (codes[j : j + n] if j < depth else np.uint64(0))
        keys.append(key)
    return np.array(keys)


def edges(units: list[str], model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the units, each followed by a 0; where units begin; table [position, length] of piece ids or -1)."""
    points = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, units), np.int64, len(units))
    start = np.cumsum(size + 1) - size - 1
    depth = model.longest
    found = np.full((len(points), depth + 1), -1, np.int32)
    alphabet = np.unique(points)
    keys = suffix_keys(points, alphabet, depth)
    array = np.lexsort(keys[::-1])
    sorted_keys = keys[:, array]
    known = set(map(chr, alphabet.tolist()))
    which = [i for i, s in enumerate(model.strings) if known.issuperset(s)]
    if not which:
        return points, start, found
    joined = np.frombuffer("".join(model.strings[i] for i in which).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(model.strings[i]) for i in which])
    codes = np.zeros((len(which), depth), np.uint64)
    codes[np.repeat(np.arange(len(which)), length), np.arange(len(joined)) - np.repeat(np.cumsum(length) - length, length)] = np.searchsorted(alphabet, joined).astype(np.uint64) + 1
    bits = max(1, int(len(alphabet) + 1).bit_length())
    each = 64 // bits
    top = np.uint64((1 << bits) - 1)
    past = np.where(np.arange(depth)[None, :] < length[:, None], codes, top)

    def packed(c):
        out = []
        for k in range(0, depth, each):
            key = np.zeros(len(which), np.uint64)
            for j in range(k, k + each):
                key = (key << np.uint64(bits)) | (c[:, j] if j < depth else np.uint64(0))
            out.append(key)
        return np.array(out)

    def search(target, right):
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(points))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(points) - 1)
            less, level = np.zeros(len(which), bool), np.ones(len(which), bool)
            for row, t in zip(sorted_keys, target, strict=True):
                v = row[mid]
                less |= level & (v < t)
                level &= v == t
            go = (less | level if right else less) & (lo < hi)
            hi = np.where(go | (lo >= hi), hi, mid)
            lo = np.where(go, mid + 1, lo)
        return lo

    first, last = search(packed(codes), False), search(packed(past), True)
    many = last - first
    rank_in = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    position = array[np.repeat(first, many) + rank_in]
    found[position, np.repeat(length, many)] = np.repeat(model.ids[which], many)  # in order of position
    return points, start, found


def _merge_long(found: np.ndarray, model: Pieces, begin: int, size: int) -> list[tuple[int, int]]:
    """Symbols (position, length) of one long word, by a heap of joinable neighbours."""
    left, right = list(range(-1, size - 1)), list(range(1, size + 1))
    length = [1] * size
    heap: list = []

    def offer(i):
        j = right[i] if i >= 0 else size
        if i < 0 or j >= size or length[i] + length[j] > model.longest:
            return
        piece = found[begin + i, length[i] + length[j]]
        if piece >= 0:
            heapq.heappush(heap, (int(model.id_rank[piece]), i, length[i], length[j]))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if length[i] != a or right[i] >= size or length[right[i]] != b:
            continue
        j = right[i]
        length[i], length[j] = a + b, 0
        right[i] = right[j]
        if right[i] < size:
            left[right[i]] = i
        offer(left[i])
        offer(i)
    return [(begin + i, n) for i, n in enumerate(length) if n]


def relax(found: np.ndarray, start: np.ndarray, size: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, position, length) of the final symbols of all units, in order."""
    short = np.flatnonzero((size > 0) & (size <= LONG))
    unit = np.repeat(short, size[short])
    pos = np.repeat(start[short], size[short]) + np.arange(len(unit)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
    length = np.ones(len(unit), np.int64)
    done: list = []
    while len(unit):
        total = length[:-1] + length[1:]
        same = (unit[:-1] == unit[1:]) & (total <= model.longest)
        piece = np.where(same, found[pos[:-1], np.minimum(total, model.longest)], -1)
        rank = np.append(np.where(piece >= 0, model.id_rank[piece], NO), NO).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.minimum.reduceat((rank << 32) | np.arange(len(unit)), heads)
        joins = (best >> 32) < NO
        counts = np.diff(np.r_[heads, len(unit)])
        live = np.repeat(joins, counts)
        if not joins.all():
            done.append((unit[~live], pos[~live], length[~live]))
        at = (best[joins] & 0xFFFFFFFF).astype(np.int64)
        length[at] += length[at + 1]
        live[at + 1] = False
        unit, pos, length = unit[live], pos[live], length[live]
    for u in np.flatnonzero(size > LONG):
        got = np.array(_merge_long(found, model, int(start[u]), int(size[u])), np.int64).reshape(-1, 2)
        done.append((np.full(len(got), u), got[:, 0], got[:, 1]))
    if not done:
        return (np.zeros(0, np.int64),) * 3
    unit, pos, length = (np.concatenate([d[k] for d in done]) for k in range(3))
    order = np.lexsort((pos, unit))
    return unit[order], pos[order], length[order]


def encode_units(units: list[str], model: Pieces) -> list[bytes]:
    """Ids of each unit, as the bytes of an int32 array."""
    if not units:
        return []
    points, start, found = edges(units, model)
    size = np.fromiter(map(len, units), np.int64, len(units))
    unit, pos, length = relax(found, start, size, model)
    ids = found[pos, length]
    if (lost := np.flatnonzero(ids < 0)).size:  # single characters that are no piece
        spelled = [model.byte_ids[np.frombuffer(chr(points[pos[k]]).encode("utf-8", "surrogatepass"), np.uint8)] for k in lost]
        many = np.ones(len(ids), np.int64)
        many[lost] = [len(s) for s in spelled]
        to = np.repeat(ids, many)
        at = np.cumsum(many) - many
        for k, s in zip(lost, spelled, strict=True):
            to[at[k] : at[k] + len(s)] = s
        unit, ids = np.repeat(unit, many), to
    ends = np.cumsum(np.bincount(unit, minlength=len(units))) * 4
    raw = ids.astype(np.int32).tobytes()
    return [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


def decode(ids: list[int], model: Pieces) -> str:
    """The text of a sequence of ids."""
    return b"".join(map(model.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model: Pieces, batch_bytes: int = 2 << 20, held_units: int = 100_000, unit_chars: int = 200_000) -> DataFrame:
    """doc_id, ids, n_ids, round_trip of every row of ``docs`` (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the size of the model's vocabulary

    def run(batches):
        m = shipped.value
        held: dict[str, bytes] = {}
        for b in arrow_batches(batches, batch_bytes):
            texts = b.column(1).to_pylist()
            split = [UNITS.findall((" " + t).replace(" ", SPACE)) if t else [] for t in texts]
            if len(held) > held_units:
                held.clear()
            new, chars = [], 0
            for u in set().union(*split).difference(held):
                new.append(u)
                chars += len(u) + 1
                if chars > unit_chars:
                    held.update(zip(new, encode_units(new, m), strict=True))
                    new, chars = [], 0
            held.update(zip(new, encode_units(new, m), strict=True))
            get = held.__getitem__
            raw = [b"".join(map(get, s)) for s in split]
            n = np.fromiter((len(r) // 4 for r in raw), np.int32, len(raw))
            none = np.array([t is None for t in texts], bool)
            offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32), mask=np.r_[none, False])
            flat = np.frombuffer(b"".join(raw), np.int32)
            same = [None if t is None else (decode(np.frombuffer(r, np.int32).tolist(), m) == t) for t, r in zip(texts, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(n, mask=none), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_ids int, round_trip boolean")


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), Pieces(MODEL))
