"""Exact top-k inner-product search.

Vectors are packed into blocks; a block of queries and a shard of candidates
meet once, as one tile: an integer matrix product, of which each query keeps
its k best by partial selection.  The lists of the tiles are merged as a tree.

Definitions:

* A component x counts as floor(scale * x).  Vectors that are null, or hold a
  null or a component that is not finite, take no part.
* Vectors of different lengths are never compared.
* A query's candidates are all rows with another id.  A query id that appears
  in several rows is searched once, with the smallest of its vectors.
  Candidate rows that repeat are candidates each.
* Best first by score, ties to the smaller id; fewer than k where there are
  fewer candidates.
* Scores are exact: products run in float64 where the bound on every sum is
  under 2**53, and in int64 otherwise (sums must fit in 64 bits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = "blk long, dim int, ids binary, mat binary, top long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    v = F.col(vec_col)
    x = v.cast("array<double>")
    fine = v.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _pack(rows: int):
    def run(batches):
        held: dict[int, list] = {}
        serial = 0

        def block(dim, got):
            nonlocal serial
            ids = np.array([g[0] for g in got], np.int64)
            mat = np.array([g[1] for g in got], np.int64).reshape(len(got), dim)
            serial += 1
            top = int(np.abs(mat).max(initial=0))
            small = mat.astype(np.int32) if top < 2**31 else mat
            return {"blk": [serial], "dim": [dim], "ids": [ids.tobytes()], "mat": [small.tobytes()], "top": [top]}

        schema = pa.schema([("blk", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("mat", pa.binary()), ("top", pa.int64())])
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = held.setdefault(len(v), [])
                got.append((i, v))
                if len(got) >= rows:
                    yield pa.RecordBatch.from_pydict(block(len(v), held.pop(len(v))), schema)
        for dim, got in held.items():
            yield pa.RecordBatch.from_pydict(block(dim, got), schema)

    return run


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dim else np.int64).reshape(n, dim)


def tile(q: np.ndarray, c: np.ndarray, exact_float: bool) -> np.ndarray:
    """Integer inner products of two blocks."""
    if exact_float:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _tiles(k: int):
    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for dim, qi, qm, qt, ci, cm, ct, shard in zip(*cols, strict=True):
                qid, cid = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                if not len(qid) or not len(cid):
                    continue
                fits = qt * ct * max(dim, 1) < 2**53
                s = tile(_matrix(qm, len(qid), dim), _matrix(cm, len(cid), dim), fits)
                order = np.argsort(cid, kind="stable")
                cid, s = cid[order], s[:, order]
                own_from, own_to = np.searchsorted(cid, qid), np.searchsorted(cid, qid, "right")
                out_q, out_c, out_s = [], [], []
                for r in range(len(qid)):
                    row = s[r]
                    keep = np.ones(len(cid), bool)
                    keep[own_from[r] : own_to[r]] = False
                    at = np.flatnonzero(keep)
                    if len(at) > k:
                        v = row[at]
                        edge = np.partition(v, len(v) - k)[len(v) - k]
                        above = at[v > edge]
                        level = at[v == edge][: k - len(above)]  # the smaller ids, as ids are sorted
                        at = np.concatenate([above, level])
                    out_q.append(np.full(len(at), qid[r]))
                    out_c.append(cid[at])
                    out_s.append(row[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_c)), pa.array(np.concatenate(out_s)), pa.array(np.full(sum(map(len, out_q)), shard, np.int64))],
                    ["query_id", "vec_id", "score", "shard"],
                )

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = 512, shard_rows: int = 4096, spread: int = 32, fan: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    ``queries`` and ``candidates`` are (id, v array<long>).  Only query blocks
    are replicated (``spread`` times); candidates move once, as packed blocks.
    """
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    qb = one.mapInArrow(_pack(query_block), BLOCK).select(F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("g"), F.col("dim"), F.col("ids").alias("qi"), F.col("mat").alias("qm"), F.col("top").alias("qt"))
    cb = candidates.mapInArrow(_pack(shard_rows), BLOCK).select(F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int").alias("g"), F.col("dim"), F.col("ids").alias("ci"), F.col("mat").alias("cm"), F.col("top").alias("ct"), F.pmod(F.xxhash64("mat"), F.lit(fan)).alias("shard"))
    tiles = qb.join(cb, ["g", "dim"]).select("dim", "qi", "qm", "qt", "ci", "cm", "ct", "shard")
    best = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score long, shard long")
    order = [F.col("score").desc(), F.col("vec_id")]
    for keys in (["query_id", "shard"], ["query_id"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 1024)
    return top_k(v.where(F.col("id") % 100 == 0), v)


OP3_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.v, c.v)::bigint score
  from e q join e c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v))
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
where rank <= 10
"""
