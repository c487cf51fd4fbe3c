"""Nearest-neighbour graphs as similarity joins.

``edges(src, dst, dist, rank)``: for each point its k nearest others, ranked
from 1 by distance, ties by ``dst``.

* ``tiles``: queries are dealt over chunks; a task holds one and meets all points
  (or a share of them) as a stream of packed blocks (``nearest.py``).  Bounds give
  candidates, so that ties are whole; they are measured by direct differences and
  cut by (dist, dst).  A task returns k rows a query, so what is shuffled grows
  with the points times the number of chunks, never with the pairs.
* ``sql``: a self-join with column expressions, as a check.  The k-th distance to a
  few points bounds what the join returns; all pairs are measured.
* ``descent``: neighbours of neighbours, for graphs of many points (``descent.py``).
* ``approx``: the same between points in a bucket of random hyperplanes, over
  several tables; hot buckets are cut into chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import TINY, distance, metric_name, unrolled
from .lineage import keep
from .nearest import Nearest, measured

EDGES = "src long, dst long, dist double"
BLOCKS = "key int, side int, dim int, ids binary, mat binary"
LEFT, RIGHT, BOTH = 0, 1, 2
HELD = 1 << 21  # numbers of a chunk's vectors
MERGED = 1 << 21  # edges that are merged at once


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>); rows without an id or a vector are left out."""
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b`` (squares of them for l2)."""
    if metric == "l2":
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    if metric == "cosine":
        return 1 - (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :])
    if metric == "jeffreys":
        la, lb = np.log(np.maximum(a, TINY)), np.log(np.maximum(b, TINY))
        return (a * la).sum(1)[:, None] + (b * lb).sum(1)[None, :] - a @ lb.T - la @ b.T
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        x, y = a[:, k][:, None], b[:, k][None, :]
        if metric == "l1":
            out += np.abs(x - y)
        else:
            m = np.log(np.maximum((x + y) / 2, TINY))
            out += (x * (np.log(np.maximum(x, TINY)) - m) + y * (np.log(np.maximum(y, TINY)) - m)) / 2
    return out


def direct(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of one vector to the rows of ``y``, without cancellation."""
    return measured(metric, x[None, :], y)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    width = np.unique(np.diff(column.offsets.to_numpy()))
    if len(width) > 1:
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(mat: np.ndarray) -> bytes:
    """In single precision where nothing is lost by that."""
    with np.errstate(over="ignore"):
        single = mat.astype(np.float32)
    return (single if np.array_equal(single, mat) else mat.astype(np.float64)).tobytes()


def _rows(dim: int, ids: bytes, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(mat, np.float32 if len(mat) == 4 * dim * len(i) and dim else np.float64).reshape(len(i), dim).astype(np.float64)


def _packed(side: int, rows: int):
    """Blocks of at most ``rows`` rows (key, id, v) of a key."""
    schema = pa.schema([("key", pa.int32()), ("side", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("mat", pa.binary())])

    def out(key, held):
        ids, mat = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_pydict({"key": [key], "side": [side], "dim": [mat.shape[1]], "ids": [ids.tobytes()], "mat": [_bytes(mat)]}, schema)

    def run(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys, ids, mat = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            order = np.argsort(keys, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                key = int(keys[part[0]])
                for lo in range(0, len(part), rows):
                    held.setdefault(key, []).append((ids[part[lo : lo + rows]], mat[part[lo : lo + rows]]))
                    size[key] = size.get(key, 0) + len(held[key][-1][0])
                    if size[key] >= rows:
                        yield out(key, held.pop(key))
                        size[key] = 0
        for key in list(held):
            yield out(key, held.pop(key))

    return run


def _met(metric: str, k: int, result, own: bool = False):
    """What ``result`` makes of (src, dst, dist) of each key's left rows among its right ones; rows come by key and side."""

    def run(batches):
        key, left, near = None, [], None

        def start():
            ids, mat = (np.concatenate(c) for c in zip(*left, strict=True))
            return Nearest(metric, k, ids, mat, own=own), ids, mat

        def end():
            n = near
            if n is None and left:
                n, *rows = start()
                if both:
                    n.add(*rows)
            return None if n is None else result(*n.result())

        both = False
        for batch in batches:
            for now, side, dim, ids, mat in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                if now != key:
                    if (r := end()) is not None:
                        yield r
                    key, left, near, both = now, [], None, False
                if side != RIGHT:
                    left.append(_rows(dim, ids, mat))
                    both = side == BOTH
                elif left:
                    if near is None:
                        near, *_ = start()
                    near.add(*_rows(dim, ids, mat))
        if (r := end()) is not None:
            yield r

    return run


def _edges(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (src, dst, dist)], ["src", "dst", "dist"])


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist, rank) of the k nearest of each src."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "dist", "rank")


def _tiles(queries: DataFrame, points: DataFrame, k: int, metric: str, rows: int, spread: int | None, own: bool = False) -> DataFrame:
    """The k nearest of each query (id, v) among points, within each of ``spread`` shares of the points."""
    size = F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")
    n, dim = points.agg(*size).first()
    asked = n if queries is points else queries.count()
    chunk = min(max(rows, -(-asked // 24)), max(rows, HELD // max(dim or 1, 1)))
    chunks = max(1, -(-asked // chunk))
    spread = spread or max(1, min(48 // chunks, n // 65536))
    dealt = lambda of, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = queries.select(dealt(chunks, 1), "id", "v").mapInArrow(_packed(LEFT, rows), BLOCKS).select("*", every(spread).alias("other"))
    right = points.select(dealt(spread, 2), "id", "v").mapInArrow(_packed(RIGHT, rows), BLOCKS).select("*", every(chunks).alias("other"))
    left = left.withColumn("key", F.col("key") * spread + F.col("other"))
    right = right.withColumn("key", F.col("other") * spread + F.col("key"))
    blocks = left.unionByName(right).drop("other").repartitionById(chunks * spread, F.col("key")).sortWithinPartitions("side")
    return blocks.mapInArrow(_met(metric, k, _edges, own), EDGES)


def knn(points: DataFrame, k: int = 10, metric: str = "l2", method: str = "tiles", queries: DataFrame | None = None, rows: int = 1024, spread: int | None = None, tables: int = 48, bits: int = 6, seed: int = 4664397, own: bool = False) -> DataFrame:
    """The k nearest neighbours of every point (or of ``queries``), as edges (src, dst, dist, rank).

    ``own``: with tiles, points with a query's id count too.

    ``spread``: over how many tasks a chunk's points are dealt; by default as many as are
    needed for tens of tasks in all.
    """
    metric = metric_name(metric)
    queries = points if queries is None else queries
    if method == "sql":
        return _by_columns(queries, points, k, metric)
    if method == "tiles":
        return top_k(_tiles(queries, points, k, metric, rows, spread, own), k)
    if method == "descent" and queries is points:
        from .descent import descent

        return descent(points, k, metric, seed=seed)
    if method != "approx":
        raise ValueError(f"unknown method {method!r}")
    return _approximate(queries, points, k, metric, tables, bits, seed)


WIDE = 256  # coordinates that are taken as columns at most


def _by_columns(queries: DataFrame, points: DataFrame, k: int, metric: str) -> DataFrame:
    """The k nearest of each query by a join on columns."""
    rows = queries.select(F.size("v").alias("n"), F.lit(0).alias("p")).unionAll(points.select(F.size("v"), F.lit(1)))
    low, high, n = rows.agg(F.min("n"), F.max("n"), F.sum("p")).first()
    if low is None or low != high or not 0 < low <= WIDE:  # arrays as they are
        a, b = queries.alias("a"), points.alias("b")
        d = a.join(b, F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), distance(metric, F.col("a.v"), F.col("b.v")).alias("dist"))
        return top_k(d, k)
    x, y = [f"x{c}" for c in range(low)], [f"y{c}" for c in range(low)]
    a = queries.select(F.col("id").alias("src"), *[F.col("v")[c].alias(x[c]) for c in range(low)])
    b = points.select(F.col("id").alias("dst"), *[F.col("v")[c].alias(y[c]) for c in range(low)])
    dist, other = unrolled(metric, [F.col(c) for c in x], [F.col(c) for c in y]), F.col("src") != F.col("dst")
    n = n or 0
    few = keep(b.orderBy(F.xxhash64("dst", F.lit(11)), "dst").limit(math.isqrt(n * k) + k + 1))
    near = top_k(a.repartition(24).join(few.hint("shuffle_replicate_nl"), other).select("src", "dst", dist.alias("dist")), k)
    bound = near.groupBy("src").agg(F.when(F.count(F.lit(1)) == k, F.max("dist")).alias("bound"))
    asked = keep(a.join(bound, "src", "left").repartition(max(24, n // 8192)))
    met = asked.join(b.repartition(max(1, n // 65536)).hint("shuffle_replicate_nl"), other & (F.col("bound").isNull() | (dist <= F.col("bound"))))
    return top_k(met.select("src", "dst", dist.alias("dist")), k)


def _signs(v: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """The bucket of each vector in each table: the signs of its projections."""
    planes = np.random.default_rng(seed).standard_normal((v.shape[1], tables * bits))
    sign = (v @ planes > 0).reshape(len(v), tables, bits) @ (1 << np.arange(bits))
    return sign + (np.arange(tables) << bits)[None, :]


def _bucket_sizes(points: DataFrame, tables: int, bits: int, seed: int) -> dict[int, int]:
    def run(batches):
        for b in batches:
            if b.num_rows:
                bucket, n = np.unique(_signs(_matrix(b.column(1)), tables, bits, seed), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    got = points.select("id", "v").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in got.collect()}  # one number a bucket, of which the parameters tell the number


def _bucket_blocks(side: int, first: dict[int, tuple[int, int]], tables: int, bits: int, seed: int):
    """Each vector once for each table, in blocks of a bucket's chunk; ``first``: a bucket's first key and its number of chunks."""
    schema = pa.schema([("key", pa.int32()), ("side", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("mat", pa.binary())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, mat = b.column(0).to_numpy(), _matrix(b.column(1))
            signs = _signs(mat, tables, bits, seed)
            for t in range(tables):
                order = np.argsort(signs[:, t], kind="stable")
                got = {n: [] for n in schema.names}
                for part in np.split(order, np.flatnonzero(np.diff(signs[order, t])) + 1):
                    key, chunks = first.get(int(signs[part[0], t]), (0, 0))
                    if not chunks:
                        continue  # nobody asks there
                    packed = [(ids[part].tobytes(), _bytes(mat[part]))]
                    if chunks > 1 and side == LEFT:
                        own = ids[part] % chunks
                        packed = [(ids[part[own == c]].tobytes(), _bytes(mat[part[own == c]])) for c in range(chunks)]
                    for c in range(chunks):
                        i, m = packed[c % len(packed)]
                        for n, x in zip(schema.names, (key + c, side, mat.shape[1], i, m), strict=True):
                            got[n].append(x)
                yield pa.RecordBatch.from_pydict(got, schema)

    return run


def _by_part(parts: int):
    def result(src, dst, dist):
        part = (src.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        cut = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(src) else []
        return pa.RecordBatch.from_arrays([pa.array([int(part[c[0]]) for c in cut], pa.int32()), *[pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (src, dst, dist)]], ["part", "src", "dst", "dist"])

    return result


def _merged(k: int):
    """The k nearest of each src of a part; rows come by part."""

    def cut(held):
        src, dst, dist = (np.concatenate([np.frombuffer(x, t) for x in c]) for c, t in zip(zip(*held, strict=True), (np.int64, np.int64, np.float64), strict=True))
        order = np.lexsort((dst, dist, src))
        src, dst, dist = src[order], dst[order], dist[order]
        new = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])][: len(src)]  # the same pair of several tables has the same distance
        src, dst, dist = src[new], dst[new], dist[new]
        start = np.flatnonzero(np.r_[True, src[1:] != src[:-1]][: len(src)])
        rank = np.arange(len(src)) - np.repeat(start, np.diff(np.r_[start, len(src)])) + 1
        return pa.RecordBatch.from_arrays([pa.array(c[rank <= k]) for c in (src, dst, dist, rank.astype(np.int32))], ["src", "dst", "dist", "rank"])

    def run(batches):
        part, held = None, []
        for b in batches:
            for now, *row in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                if now != part and held:
                    yield cut(held)
                    held = []
                part = now
                held.append(row)
        if held:
            yield cut(held)

    return run


def _approximate(queries: DataFrame, points: DataFrame, k: int, metric: str, tables: int, bits: int, seed: int) -> DataFrame:
    """The k nearest of each query among the points that share a bucket with it in some table."""
    dim = points.select(F.size("v").alias("n")).first()
    if dim is None:
        return top_k(points.sparkSession.createDataFrame([], EDGES), k)
    sizes = _bucket_sizes(queries, tables, bits, seed)
    most = max(64, HELD // max(dim["n"], 1))
    first, keys = {}, 0
    for bucket in sorted(sizes):
        first[bucket] = (keys, -(-sizes[bucket] // most))
        keys += first[bucket][1]
    packed = lambda rows, side, of: rows.select("id", "v").mapInArrow(_bucket_blocks(side, of, tables, bits, seed), BLOCKS)
    cold = {b: x for b, x in first.items() if x[1] == 1} if queries is points else {}
    hot = {b: x for b, x in first.items() if b not in cold}
    blocks = packed(points, BOTH, cold) if cold else None
    if hot or not cold:
        two = packed(queries, LEFT, hot).unionByName(packed(points, RIGHT, hot))
        blocks = two if blocks is None else blocks.unionByName(two)
    found = blocks.repartition(min(max(keys, 1), 192), "key").sortWithinPartitions("key", "side")
    parts = max(8, -(-sum(sizes.values()) * k // MERGED))
    found = found.mapInArrow(_met(metric, k, _by_part(parts)), "part int, src binary, dst binary, dist binary")
    return found.repartitionById(parts, F.col("part")).mapInArrow(_merged(k), "src long, dst long, dist double, rank int")


def sampled_recall(found, points: DataFrame, queries: DataFrame, k: int, metric: str, n: int = 256, own: bool = False) -> float:
    """Share of the exact neighbours of ``n`` queries, drawn by a hash of their ids, that ``found`` (of these queries) has; one pass over the points."""
    sample = keep(queries.select("id", "v").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(n))
    share = recall(keep(knn(points, k, metric, queries=sample, own=own)), found(sample)).first()["recall"]
    return 1.0 if share is None else share


def recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate graph has."""
    hit = exact.select("src", "dst").join(approx.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
