"""Hard-negative mining by exact search over one-dimensional distance keys.

Vectors get one more component, so that all have the same length; then a larger
inner product with a query is a smaller distance from it.  Every row belongs to
its nearest pivot, and its key is its distance from it.  The index is a table of
blocks of rows stored sorted by (pivot, key).

A search asks for the k best rows of a range of scores, of the anchor's label or
of others.  Rows within a distance r of a query have keys within r of the
query's own distance from the pivot, so they are found in one interval of keys
a pivot; the range's upper end cuts rows out that are too near.  Intervals start
where a sample of rows promises k results, and grow by what they lack (an
annulus a round) until the k-th result is nearer than all that was not scanned.
Searches travel in tiles, so that a tile and a block meet once, as a matrix
product.  Pivots and first radii come from a bounded sample; they change how
much is scanned, not what is found.

Definitions:

* A component x counts as floor(scale * x).  Rows with a null label, id or
  vector, or with a null or non-finite component, take no part.
* Vectors of different lengths are never compared.
* An id that is an anchor in several rows is searched once, by the smallest
  (label, vector).  Rows with the anchor's own id are neither positives nor
  negatives of it.  Other repeated rows are rows each.
* Best first by score, ties to the smaller id; fewer where there are fewer.
* Scores are exact: products run in float64 where the bound on every sum is under
  2**53, and in int64 otherwise (sums must fit in 62 bits).
* An empty table gives an empty result.  Further columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .topk_search import tile

ROWS = "id long, label long, v array<long>"
BLOCK = "pivot int, blk long, low double, high double, keys binary, ids binary, labels binary, mat binary, top long"
TILE = "tile long, asks binary, mat binary, top long, spans array<struct<pivot: int, low: double, high: double>>"
ASK = np.dtype([("ask", np.int64), ("anchor", np.int64), ("label", np.int64), ("lo", np.int64), ("hi", np.int64), ("before", np.float64), ("radius", np.float64)])
SAMPLE = 2048
EVER = 1 << 62


def mined_rows(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v array<long>) of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.col(vec_col).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda e: F.floor(e * scale)).alias("v")).where(F.col("label").isNotNull())


def _matrix(values: list[list[int]], dim: int) -> np.ndarray:
    return np.array(values, np.int64).reshape(len(values), dim)


def _small(mat: np.ndarray) -> tuple[bytes, int]:
    """A matrix's bytes in the smallest of 2, 4 and 8 bytes a number, and its largest number."""
    top = int(np.abs(mat).max(initial=0))
    return mat.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64).tobytes(), top


def _large(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // max(n * dim, 1) or 8]).reshape(n, dim).astype(np.int64)


class Space:
    """The pivots of an index over vectors of one length, and a bounded sample of its rows."""

    def __init__(self, dim: int, longest: float, total: int, labels: np.ndarray, ids: np.ndarray, mat: np.ndarray, pivots: int, seed: int = 7):
        self.dim, self.longest, self.total = dim, longest, total
        self.labels, self.ids, self.mat = labels, ids, mat
        raised = self.raised(mat)
        rng = np.random.default_rng(seed)
        self.pivots = raised[rng.permutation(len(raised))[:pivots]]
        for _ in range(4):
            near = self.squares(raised).argmin(1)
            self.pivots = np.stack([raised[near == p].mean(0) if (near == p).any() else self.pivots[p] for p in range(len(self.pivots))])

    def raised(self, mat: np.ndarray) -> np.ndarray:
        """Rows with the component that gives all the same length."""
        x = mat.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))]

    def squares(self, x: np.ndarray) -> np.ndarray:
        p = self.pivots
        return (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T)

    def keys(self, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance from it of every row."""
        x = self.raised(mat)
        near = self.squares(x).argmin(1)
        return near, np.sqrt(((x - self.pivots[near]) ** 2).sum(1))

    def to_pivots(self, mat: np.ndarray) -> np.ndarray:
        """Distances of searched vectors (whose further component is 0) from every pivot."""
        x = np.c_[mat.astype(np.float64), np.zeros(len(mat))]
        return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in self.pivots], axis=1))

    def distance(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance from a searched vector, given its squared length, at which a row has a score."""
        return np.sqrt(np.maximum(square + self.longest - 2.0 * score, 0.0))

    def interval(self, gap: np.ndarray, square: np.ndarray, hi: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys that rows within ``radius`` with a score of at most ``hi`` can have, at a pivot ``gap`` away; padded for rounding."""
        pad = 1e-7 * (1 + gap + math.sqrt(self.longest))
        inner = self.distance(square, hi)
        low = np.maximum(gap - radius, np.where(hi < EVER, inner, 0.0) - gap) - pad
        return np.where(radius < 0, np.inf, low), np.where(radius < 0, -np.inf, gap + radius + pad)


def _space(rows: DataFrame, dim: int, pivots: int | None) -> Space:
    of = rows.where(F.size("v") == dim)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest = of.agg(F.count(F.lit(1)), F.max(square)).first()
    held = of.orderBy(F.xxhash64("id", F.lit("sample")), "id", "label", "v").limit(SAMPLE).collect()  # at most SAMPLE rows
    mat = _matrix([r["v"] for r in held], dim)
    count = pivots or max(1, min(math.isqrt(total // 1024), 1024, (1 << 22) // (dim + 1)))
    return Space(dim, longest or 0.0, total, np.array([r["label"] for r in held], np.int64), np.array([r["id"] for r in held], np.int64), mat, count)


def index(rows: DataFrame, space: Space, block: int = 4096) -> DataFrame:
    """The blocks of all rows, sorted by (pivot, key); a block has rows of one pivot."""

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                near, key = space.keys(_matrix(b.column(2).to_pylist(), space.dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(key)], ["id", "label", "v", "pivot", "key"])

    def packed(batches):
        part, serial = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def out(got):
            nonlocal serial
            serial += 1
            mat, top = _small(_matrix([g[2] for g in got], space.dim))
            keys = np.array([g[4] for g in got])
            ids, labels = (np.array([g[k] for g in got], np.int64) for k in (0, 1))
            row = [got[0][3], (part << 32) | serial, keys[0], keys[-1], keys.tobytes(), ids.tobytes(), labels.tobytes(), mat, top]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], [f.split()[0] for f in BLOCK.split(", ")])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (held[0][3] != row[3] or len(held) >= block):
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    order = ["pivot", "key", "id"]
    k = rows.where(F.size("v") == space.dim).mapInArrow(keyed, f"{ROWS}, pivot int, key double")
    parts = space.total // (4 * block) + 1
    return materialise(k.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(packed, BLOCK), "distance-keys")


def _radii(space: Space, k: int, same: bool):
    """Sets the radius of each ask: the distance of its ``at``-th best row of the sample, or beyond everything."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            names = b.schema.names
            col = {c: b.column(names.index(c)) for c in names}
            v = _matrix(col["v"].to_pylist(), space.dim)
            square = (v.astype(np.float64) ** 2).sum(1)
            scores = v.astype(np.float64) @ space.mat.astype(np.float64).T
            out = []
            for i, (a, label, lo, hi, at) in enumerate(zip(*(col[c].to_numpy() for c in ("anchor", "label", "lo", "hi", "at")), strict=True)):
                s = scores[i]
                s = s[((space.labels == label) == same) & (space.ids != a) & (s >= lo) & (s <= hi)]
                far = space.distance(square[i], lo) if lo > -EVER else np.inf
                out.append(min(space.distance(square[i], np.partition(s, len(s) - at)[len(s) - at]) * (1 + 1e-9), far) if len(s) >= at else far)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(out, np.float64))], [*names, "radius"])

    return run


def _tiled(space: Space, size: int):
    """Asks, which come sorted by pivot, as tiles with the keys that they need of every pivot."""

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        for b in batches:
            col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for start in range(0, b.num_rows, size):
                cut = slice(start, min(start + size, b.num_rows))
                asks = np.empty(cut.stop - cut.start, ASK)
                for c in ASK.names:
                    asks[c] = col[c].to_numpy()[cut]
                mat = _matrix(col["v"].slice(cut.start, len(asks)).to_pylist(), space.dim)
                gap, square = space.to_pivots(mat), (mat.astype(np.float64) ** 2).sum(1)
                low, high = space.interval(gap, square[:, None], asks["hi"][:, None], asks["radius"][:, None])
                spans = [{"pivot": p, "low": float(low[:, p].min()), "high": float(high[:, p].max())} for p in range(len(space.pivots))]
                raw, top = _small(mat)
                serial += 1
                yield pa.RecordBatch.from_pydict({"tile": [(part << 32) | serial], "asks": [asks.tobytes()], "mat": [raw], "top": [top], "spans": [spans]}, pa.schema([("tile", pa.int64()), ("asks", pa.binary()), ("mat", pa.binary()), ("top", pa.int64()), ("spans", pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])))]))

    return run


def _scan(space: Space, k: int, same: bool):
    """The k best rows of a block for each ask of a tile, among those of its annulus."""

    def run(batches):
        for b in batches:
            for raw_asks, raw_q, top_q, pivot, raw_keys, raw_ids, raw_labels, raw_mat, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                asks, keys, ids, labels = np.frombuffer(raw_asks, ASK), np.frombuffer(raw_keys, np.float64), np.frombuffer(raw_ids, np.int64), np.frombuffer(raw_labels, np.int64)
                q = _large(raw_q, len(asks), space.dim)
                square = (q.astype(np.float64) ** 2).sum(1)
                gap = space.to_pivots(q)[:, pivot]
                spans = [np.searchsorted(keys, x, side) for r in ("radius", "before") for x, side in zip(space.interval(gap, square, asks["hi"], asks[r]), ("left", "right"), strict=True)]
                distinct, which = np.unique(asks["anchor"], return_inverse=True)
                first = np.zeros(len(distinct), np.int64)
                first[which] = np.arange(len(asks))
                s = tile(q[first], _large(raw_mat, len(ids), space.dim), top_q * top * max(space.dim, 1) < 2**53)
                out = []
                for i, ask in enumerate(asks):
                    a, z, c, d = (int(x[i]) for x in spans)
                    at = np.r_[a : max(a, min(c, z)), max(a, d) : max(z, a, d)] if c < d else np.arange(a, max(a, z))
                    row = s[which[i], at]
                    fit = ((labels[at] == ask["label"]) == same) & (ids[at] != ask["anchor"]) & (row >= ask["lo"]) & (row <= ask["hi"])
                    at, row = at[fit], row[fit]
                    if len(at) > k:
                        edge = np.partition(row, len(row) - k)[len(row) - k]
                        best = row >= edge
                        at, row = at[best], row[best]
                        best = np.lexsort((ids[at], -row))[:k]
                        at, row = at[best], row[best]
                    out.append((np.full(len(at), ask["ask"]), ids[at], row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["ask", "id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("ask", "id", "score", "rank")


def search(blocks: DataFrame, space: Space, asks: DataFrame, k: int, same: bool, size: int = 256) -> DataFrame:
    """(ask, id, score, rank): the k best rows of each ask (ask, anchor, label, v, lo, hi) with a score from lo to hi, of its label or of others."""
    start = max(1, math.ceil(2 * k * len(space.ids) / max(space.total, 1)))
    columns = ["ask", "anchor", "label", "v", "lo", "hi", "at", "before"]
    asked = "ask long, anchor long, label long, v array<long>, lo long, hi long, at long, before double"
    left = asks.where(F.col("lo") <= F.col("hi")).withColumn("at", F.lit(start).cast("long")).withColumn("before", F.lit(-1.0)).select(*columns)
    found = None
    while True:
        left = materialise(left.mapInArrow(_radii(space, k, same), f"{asked}, radius double"), "asks")
        if left.isEmpty():
            return found if found is not None else _best(left.select("ask", F.col("anchor").alias("id"), F.col("lo").alias("score")), k)
        tiles = materialise(left.repartitionByRange("anchor", "ask").sortWithinPartitions("anchor", "ask").mapInArrow(_tiled(space, size), TILE), "tiles")
        want = tiles.select("tile", F.inline("spans")).where(F.col("low") <= F.col("high"))
        meta = blocks.select(F.col("pivot").alias("p"), "blk", F.col("low").alias("from"), F.col("high").alias("to"))
        pairs = want.join(meta, (F.col("pivot") == F.col("p")) & (F.col("from") <= F.col("high")) & (F.col("to") >= F.col("low"))).select("tile", "blk")
        met = pairs.join(tiles.select("tile", "asks", F.col("mat").alias("q"), F.col("top").alias("qt")), "tile").join(blocks.drop("low", "high"), "blk")
        got = met.select("asks", "q", "qt", "pivot", "keys", "ids", "labels", "mat", "top").mapInArrow(_scan(space, k, same), "ask long, id long, score long")
        found = materialise(_best(got if found is None else got.unionByName(found.drop("rank")), k), "found")
        # done: beyond the radius nothing is asked for, or the k-th result is within it
        last = found.where(F.col("rank") == k).select("ask", F.col("score").alias("kth"))
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        reach = lambda score: F.sqrt(F.greatest(square + F.lit(space.longest) - 2.0 * score, F.lit(0.0)))
        all_seen = (F.col("radius") == float("inf")) | ((F.col("lo") > -EVER) & (F.col("radius") >= reach(F.col("lo"))))
        open_ = left.join(last, "ask", "left").where(~(all_seen | F.coalesce(reach(F.col("kth")) <= F.col("radius"), F.lit(False))))
        left = open_.withColumn("before", F.col("radius")).withColumn("at", F.col("at") * 4).select(*columns)


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, block: int = 4096, pivots: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` and ``rows`` are (id, label, v); a negative's score is from
    ``least`` to ``most`` per cent of the positive's.
    """
    rows = materialise(rows, "vectors")
    out = None
    for (dim,) in rows.select(F.size("v")).distinct().collect():  # one index for vectors of one length
        space = _space(rows, dim, pivots)
        blocks = index(rows, space, block)
        one = anchors.where(F.size("v") == dim).groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("label", "v")).alias("m")).select("anchor", "m.*")
        one = materialise(one, "anchors")
        ever = F.lit(EVER).cast("long")
        near = search(blocks, space, one.select(F.col("anchor").alias("ask"), "anchor", "label", "v", (-ever).alias("lo"), ever.alias("hi")), n_positives, True)
        pairs = near.select(F.col("ask").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))
        pairs = materialise(pairs.withColumn("ask", F.monotonically_increasing_id()), "positives")
        # least and most per cent of the score, rounded inwards without leaving the integers
        share = "((positive_score - pmod(positive_score, 100)) div 100) * {0} + (pmod(positive_score, 100) * {0} + {1}) div 100"
        lo, hi = F.expr(share.format(least, 99)), F.expr(share.format(most, 0))
        asks = pairs.join(one, "anchor").select("ask", "anchor", "label", "v", lo.alias("lo"), hi.alias("hi"))
        got = search(blocks, space, asks, n_negatives, False)
        mined = got.join(pairs, "ask").select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = mined if out is None else out.unionByName(mined)
    if out is None:
        spark = rows.sparkSession
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = mined_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "vec_id", "embedding", label, 256)
    return hard_negatives(rows, rows.where(F.col("id") % 100 == 0))


OP13_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where embedding is not null and vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id a, c.vec_id c, q.l = c.l same, list_inner_product(q.v, c.v)::bigint score
  from e q join e c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
p as (select a, c, score from (select *, row_number() over (partition by a order by score desc, c) r from s where same) where r <= 5),
n as (
  select p.a anchor_id, p.c positive_id, s.c negative_id, p.score positive_score, s.score negative_score,
    row_number() over (partition by p.a, p.c order by s.score desc, s.c) as rank
  from p join s on s.a = p.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
