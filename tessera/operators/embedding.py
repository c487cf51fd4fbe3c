"""Entropy embedding: coordinates whose distances give the edge probabilities.

Nodes are dealt into blocks of a fixed number of nodes that are near each other
at the start (by the order of a curve through the plane of their first two
coordinates), and coordinates move as one packed row a block.  An epoch is one
job of three steps, each linear in the number of edges:

* blocks send each other the coordinates that their edges need (their rims);
* every block draws its edges by their weights, in batches, and moves its own
  copy of the nodes and of the rim.  Far nodes come from a pool of a fixed size,
  drawn anew each epoch in proportion to hubness by alias tables, one a block and
  one over the blocks;
* moves return to the blocks that own the nodes, and a node takes the mean of its
  moves, weighted by how often it was drawn where.

Random numbers are seeded by epoch and block, so results do not depend on how
Spark partitions the work; there is one way of working for every size.  (Only a graph of a single block goes
through its epochs in one job, with the same result.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import data_box
from ..functions.vectors import cauchy_weight, squared_distance
from ..params import DiffusionParams, EmbedderParams
from .alias import alias_table, draw
from .diffusion import dmap_embed
from .graph import numbered
from .hubness import hubness
from .lineage import dropped, keep, stored
from .proba import proba_edges, scales

NEGATIVES = 5
NODES = 4096
POOL = 1 << 14


def embedded_scales(first: DataFrame) -> DataFrame:
    """(id, scale): a fifth of the scale over the mean, held within a quarter and four."""
    mean = first.agg(F.avg("scale").alias("m"))
    return first.join(F.broadcast(mean), how="cross").select("id", (0.2 * F.least(F.greatest(F.col("scale") / F.col("m"), F.lit(0.25)), F.lit(4.0))).alias("scale"))


def cross_entropy(kernel: DataFrame, coords: DataFrame, low: DataFrame, b: float = 1.0) -> DataFrame:
    """One row (ce): cross entropy of the edge weights and those of the embedded edges."""
    x = coords.select(F.col("id").alias("src"), F.col("coords").alias("x"))
    y = coords.select(F.col("id").alias("dst"), F.col("coords").alias("y"))
    e = kernel.join(x, "src").join(y, "dst").join(low.select(F.col("id").alias("src"), F.col("scale").alias("a")), "src")
    c = cauchy_weight(squared_distance(F.col("x"), F.col("y")), F.col("a"), b)
    near = F.when(F.col("w") > 0, -F.col("w") * F.log(c)).otherwise(0.0)
    far = F.when(F.col("w") < 1, -(1 - F.col("w")) * F.log(1 - c)).otherwise(0.0)
    return e.withColumn("c", c).agg(F.sum(near + F.when(c < 1, far).otherwise(0.0)).alias("ce"))


def random_init(ids: DataFrame, dim: int, size: float, seed: int) -> DataFrame:
    """Uniform coordinates within half of ``size``, by id and seed."""
    u = [(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(1 << 52)) / float(1 << 52) - 0.5) * size for j in range(dim)]
    return ids.select("id", F.array(*u).alias("coords"))


def _coefficient(d: np.ndarray, scale: np.ndarray, b: float) -> np.ndarray:
    c = 2 * b / (1 + d**b) / (scale * scale)
    return c if b == 1 else c * np.where(d > 0, d, 1.0) ** (b - 1)


def _scatter(out: np.ndarray, at: np.ndarray, move: np.ndarray) -> None:
    """Add rows of ``move`` to rows ``at`` of ``out``."""
    for j in range(out.shape[1]):
        out[:, j] += np.bincount(at, weights=move[:, j], minlength=len(out))


def _steps(y: np.ndarray, own: int, edges: np.ndarray, known: np.ndarray, samples: int, step: float, b: float, rng: np.random.Generator, pool: np.ndarray, far: np.ndarray, first: int) -> np.ndarray:
    """Take ``samples`` edge draws on ``y`` in place, in batches with few nodes in common; how often each node was drawn.

    ``known`` are the edges as sorted numbers (node of the block, number of the other end).

    ``y`` has the block's ``own`` nodes, the first of which is number ``first``,
    and its rim.  Far nodes are those of the pool, with numbers ``pool``; they do
    not move.  Of the block's own nodes the place they have just now counts, of
    others ``far``, which is where they were when the epoch began.
    """
    total = np.cumsum(edges["w"])
    batch, drawn = max(16, own // 4), np.zeros(len(y), np.int64)
    at_hand = (pool >= first) & (pool < first + own)
    place = np.where(at_hand, pool - first, 0)
    for done in range(0, samples, batch):
        at = np.minimum(np.searchsorted(total, rng.random(min(batch, samples - done)) * total[-1]), len(edges) - 1)
        e = edges[at]
        i, j, s, p = e["i"], e["j"], e["a"], e["w"]
        gap = y[j] - y[i]
        d = (gap * gap).sum(1) / (s * s)
        pull = np.maximum(step * _coefficient(d, s, b) * (-p + (1 - p) / np.maximum(d * d, 1e4)), -0.49)
        move = np.where(d > 0, pull, 0.0)[:, None] * gap
        delta = np.zeros_like(y)
        _scatter(delta, i, -move)
        _scatter(delta, j, move)
        k = rng.integers(0, len(pool), NEGATIVES * len(i))
        near, src, s = np.tile(i, NEGATIVES), np.tile(e["src"], NEGATIVES), np.tile(s, NEGATIVES)
        gap = np.where(at_hand[k][:, None], y[place[k]], far[k]) - y[near]
        d2 = (gap * gap).sum(1)
        d = d2 / (s * s)
        push = np.minimum(step * _coefficient(d, s, b) / np.maximum(d * d, 1 / 16), 2.0)
        felt = np.flatnonzero((push > 1e-9) & (d2 > 0) & (pool[k] != src))  # of most far nodes nothing is felt
        pair = (near[felt].astype(np.int64) << 48) | pool[k[felt]]
        felt = felt[known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] != pair]
        _scatter(delta, near[felt], -push[felt][:, None] * gap[felt])
        count = np.bincount(i, minlength=len(y)) + np.bincount(j, minlength=len(y))
        y += delta / np.maximum(count, 1)[:, None]
        drawn += count
    return drawn


#: An edge of a block: its ends among the block's nodes and rim, their numbers among all nodes, its weight and its scale.
EDGE = np.dtype([("i", np.int32), ("j", np.int32), ("src", np.int64), ("dst", np.int64), ("w", np.float64), ("a", np.float64)])


def _curve(coords: DataFrame, dim: int) -> DataFrame:
    """``coords`` with a column z: the place of the first two coordinates on a curve that keeps neighbours together."""
    ends = coords.agg(*[f(F.col("coords")[j]).alias(f"{n}{j}") for j in range(min(dim, 2)) for f, n in ((F.min, "lo"), (F.max, "hi"))])

    def spread(j: int) -> Column:
        """The 16 bits of a coordinate with a gap after each."""
        x = F.when(F.col(f"hi{j}") > F.col(f"lo{j}"), F.floor((F.col("coords")[j] - F.col(f"lo{j}")) / (F.col(f"hi{j}") - F.col(f"lo{j}")) * 65535)).otherwise(0).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    z = spread(0) if dim < 2 else spread(0).bitwiseOR(F.shiftleft(spread(1), 1))
    return coords.join(F.broadcast(ends), how="cross").select("id", "coords", z.alias("z"))


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("b").sortWithinPartitions("b", *order)


def _groups(batches, one):
    """Calls ``one(b, columns)`` for each run of rows with the same first column, across batches; yields its record batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        b = t.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist()]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            yield from one(int(b[lo]), t.slice(lo, hi - lo))
        held = t.slice(edge[-1])
    if held is not None:
        yield from one(int(held.column(0)[0].as_py()), held)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


BLOCK = "b long, o long, data binary"
PLACE = "b long, y binary, alias binary"
PIECE = "b long, kind int, o long, data binary, at binary"
MOVE = "b long, kind int, o long, data binary, at binary, drawn binary"


def _packed_nodes(dim: int):
    """A row a block: its nodes' coordinates, the alias table of their weights, their ids and the sum of the weights."""

    def one(b, t):
        y = np.array(t.column("coords").to_pylist(), np.float64).reshape(t.num_rows, dim)
        w = t.column("weight").to_numpy()
        share, other = alias_table(w)
        yield _batch([(b, y.tobytes(), share.tobytes() + other.tobytes(), t.column("id").to_numpy().tobytes(), float(w.sum()))], f"{PLACE}, ids binary, total double")

    return lambda batches: _groups(batches, one)


def _packed_edges(nodes: int):
    """Edges of each block (o = -1), and for each other block (o) which of its nodes are in the rim."""

    def one(b, t):
        e = np.empty(t.num_rows, EDGE)
        e["src"], e["dst"], e["w"], e["a"] = (t.column(c).to_numpy() for c in ("src", "dst", "w", "a"))
        e["i"] = e["src"] % nodes
        inside = e["dst"] // nodes == b
        rim = np.unique(e["dst"][~inside])
        e["j"] = np.where(inside, e["dst"] % nodes, nodes + np.searchsorted(rim, e["dst"]))
        rows = [(b, -1, e.tobytes())]
        for o in np.unique(rim // nodes).tolist():
            rows.append((b, o, (rim[rim // nodes == o] % nodes).astype(np.int32).tobytes()))
        yield _batch(rows, BLOCK)

    return lambda batches: _groups(batches, one)


def _pool_draws(seed: int, epoch: int, nodes: int, dim: int, size: int):
    """This block's part of the pool; which part is told by draws from the table over the blocks, which every block repeats."""

    def run(batches):
        shards = None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for b, y, table, bs, totals in zip(*(col[c].to_pylist() for c in ("b", "y", "alias", "bs", "totals")), strict=True):
                if shards is None:
                    at = draw(*alias_table(np.array(totals)), size, np.random.default_rng([seed, epoch]))
                    shards = dict(zip(*np.unique(np.array(bs)[at], return_counts=True), strict=True))
                got = int(shards.get(b, 0))
                if got:
                    n = len(table) // 16
                    k = draw(np.frombuffer(table, np.float64, n), np.frombuffer(table, np.int64, n, 8 * n), got, np.random.default_rng([seed, epoch, b, 1]))
                    yield _batch([(b, (b * nodes + k).tobytes(), np.frombuffer(y, np.float64).reshape(-1, dim)[k].tobytes())], "b long, idx binary, y binary")

    return run


def _gather(dim: int):
    """The coordinates that a block's rim has of another block."""

    def run(batches):
        for batch in batches:
            rows = [(b, 2, o, np.frombuffer(y, np.float64).reshape(-1, dim)[np.frombuffer(at, np.int32)].tobytes(), at) for b, o, at, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _batch(rows, PIECE)

    return run


def _move(nodes: int, dim: int, params: EmbedderParams, step: float, epoch: int, per_weight: float):
    """A block's epoch: its pool, edges, coordinates and rim come in this order; its nodes' moves go out by the blocks that own them."""

    def one(b, t):
        kind, other, data = t.column("kind").to_numpy(), t.column("o").to_numpy(), t.column("data").to_pylist()
        edges = [np.frombuffer(d, EDGE) for d, k in zip(data, kind, strict=True) if k == 0]
        start = np.frombuffer(next(d for d, k in zip(data, kind, strict=True) if k == 1), np.float64).reshape(-1, dim)
        if not edges:
            return
        edges, own = edges[0].copy(), len(start)
        pool = next(p for p in t.column("pool").to_pylist() if p is not None)
        idx, far = (np.concatenate([np.frombuffer(p[c], k) for p in pool]) for c, k in (("idx", np.int64), ("y", np.float64)))
        pieces = [(int(o), np.frombuffer(d, np.float64).reshape(-1, dim), at) for o, d, k, at in zip(other, data, kind, t.column("at").to_pylist(), strict=True) if k == 2]
        y = np.concatenate([start, *(p for _, p, _ in pieces)])
        before = y.copy()
        edges["j"] -= np.where(edges["j"] >= nodes, nodes - own, 0).astype(np.int32)  # the last block has fewer nodes
        known = np.sort((edges["i"].astype(np.int64) << 48) | edges["dst"])
        samples = round(per_weight * float(edges["w"].sum()))
        drawn = _steps(y, own, edges, known, samples, step, params.b, np.random.default_rng([params.seed, epoch, b, 2]), idx, far.reshape(-1, dim), b * nodes)
        moved, done = y - before, own
        rows = [(b, 1, b, moved[:own].tobytes(), b"", drawn[:own].tobytes())]
        for o, p, at in pieces:
            rows.append((o, 1, b, moved[done : done + len(p)].tobytes(), at, drawn[done : done + len(p)].tobytes()))
            done += len(p)
        yield _batch(rows, MOVE)

    return lambda batches: _groups(batches, one)


def _apply(dim: int):
    """A block's coordinates after all moves of its nodes; moves come with the numbers of the nodes, or for all nodes of the block."""

    def one(b, t):
        kind, data, at, drawn = t.column("kind").to_numpy(), *(t.column(c).to_pylist() for c in ("data", "at", "drawn"))
        held = int(np.flatnonzero(kind == 0)[0])
        y = np.frombuffer(data[held], np.float64).reshape(-1, dim).copy()
        total, count = np.zeros_like(y), np.zeros(len(y), np.int64)
        for k, d, rows, c in zip(kind, data, at, drawn, strict=True):
            if k == 1:
                rows = np.frombuffer(rows, np.int32) if len(rows) else np.arange(len(y))
                times = np.frombuffer(c, np.int64)
                total[rows] += np.frombuffer(d, np.float64).reshape(-1, dim) * times[:, None]
                count[rows] += times
        y += total / np.maximum(count, 1)[:, None]
        yield _batch([(b, y.tobytes(), at[held])], PLACE)

    return lambda batches: _groups(batches, one)


def _alone(dim: int, params: EmbedderParams, per_weight: float, size: int):
    """All epochs of a graph of one block, which needs nothing of others between them; the same as one job an epoch."""

    def run(batches):
        for batch in batches:
            for raw, table, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y, edges, n = np.frombuffer(raw, np.float64).reshape(-1, dim).copy(), np.frombuffer(data, EDGE), len(table) // 16
                share, other = np.frombuffer(table, np.float64, n), np.frombuffer(table, np.int64, n, 8 * n)
                known = np.sort((edges["i"].astype(np.int64) << 48) | edges["dst"])
                samples = round(per_weight * float(edges["w"].sum()))
                for k in range(params.nb_grad_batch):
                    pool = draw(share, other, size, np.random.default_rng([params.seed, k, 0, 1]))
                    after = y.copy()
                    drawn = _steps(after, len(y), edges, known, samples, _step(params, k), params.b, np.random.default_rng([params.seed, k, 0, 2]), pool, y[pool], 0)[:, None]
                    y += (after - y) * drawn / np.maximum(drawn, 1)
                yield _batch([(y.tobytes(), ids)], "y binary, ids binary")

    return run


def _step(params: EmbedderParams, epoch: int) -> float:
    return params.grad_step * (1 - (epoch + 1) / params.nb_grad_batch)


def _unpacked(dim: int):
    def run(batches):
        for batch in batches:
            for y, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = np.frombuffer(y, np.float64).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(list(c), pa.list_(pa.float64()))], ["id", "coords"])

    return run


def optimise(kernel: DataFrame, initial: DataFrame, params: EmbedderParams, hubs: DataFrame | None = None, nodes: int = NODES, pool: int = POOL, one_job: bool = True) -> DataFrame:
    """(id, coords) after ``nb_grad_batch`` epochs with a step that falls to 0.

    ``nodes`` is the number of nodes of a block, ``pool`` the number of far nodes
    that an epoch draws; with ``hubs`` (id, hubness) they are drawn in proportion
    to hubness, held within 1 and the number of nodes.  ``one_job``: whether a
    graph of a single block may go through its epochs in one job.
    """
    dim = params.asked_dim
    low = embedded_scales(scales(kernel))
    # sums differ in their last bits with the order of their parts, and steps would carry that on: what goes in is rounded
    initial = initial.select("id", F.transform("coords", lambda c: F.round(c, 4)).alias("coords"))
    placed = keep(numbered(_curve(initial, dim), ["z", "id"], "idx").select("id", "coords", "idx"))
    n = placed.count()
    if hubs is None:
        weighed = placed.withColumn("weight", F.lit(1.0))
    else:
        weight = F.least(F.greatest(F.coalesce("hubness", F.lit(1)), F.lit(1)), F.lit(n)).cast("double")
        weighed = placed.join(hubs, "id", "left").withColumn("weight", weight)
    block = F.floor(F.col("idx") / nodes).cast("long")
    parts = keep(_by_block(weighed.select(block.alias("b"), "idx", "id", "coords", "weight"), "idx").mapInArrow(_packed_nodes(dim), f"{PLACE}, ids binary, total double"))
    named = lambda c: placed.select(F.col("id").alias(c), F.col("idx").alias(f"{c}_idx"))
    e = kernel.select("src", "dst", "w").join(low.select(F.col("id").alias("src"), F.col("scale").alias("a")), "src").join(named("src"), "src").join(named("dst"), "dst")
    e = e.select(F.floor(F.col("src_idx") / nodes).cast("long").alias("b"), F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), F.col("w").cast("float").cast("double").alias("w"), F.col("a").cast("float").cast("double").alias("a"))
    fixed = keep(_by_block(e, "src", "dst").mapInArrow(_packed_edges(nodes), BLOCK))
    edges, rims = fixed.where(F.col("o") == -1), fixed.where(F.col("o") >= 0)
    size, weight = e.agg(F.count(F.lit(1)), F.sum("w")).first()
    per_weight = params.nb_sampling_by_edge * size / weight if size else 0.0
    out = "id long, coords array<double>"
    if n <= nodes and size and one_job:
        alone = parts.select("b", "y", "alias", "ids").join(edges.select("b", "data"), "b").select("y", "alias", "ids", "data")
        return keep(alone.mapInArrow(_alone(dim, params, per_weight, pool), "y binary, ids binary").mapInArrow(_unpacked(dim), out))
    over = keep(parts.agg(F.sort_array(F.collect_list(F.struct("b", "total"))).alias("s")).select(F.col("s.b").alias("bs"), F.col("s.total").alias("totals")))  # one number a block
    y = parts.select("b", "y", "alias")
    no_pool, none = F.lit(None).cast("array<struct<b: bigint, idx: binary, y: binary>>"), F.lit(b"")
    for k in range(params.nb_grad_batch):
        step = _step(params, k)
        if not size:
            break
        drawn = y.join(F.broadcast(over), how="cross").mapInArrow(_pool_draws(params.seed, k, nodes, dim, pool), "b long, idx binary, y binary")
        far = F.broadcast(drawn.agg(F.sort_array(F.collect_list(F.struct("b", "idx", "y"))).alias("pool")))  # ``pool`` nodes
        rim = rims.join(y.select(F.col("b").alias("o"), "y"), "o").select("b", "o", "data", "y").mapInArrow(_gather(dim), PIECE)
        rows = edges.join(far, how="cross").select("b", F.lit(0).alias("kind"), "o", "data", none.alias("at"), "pool")
        own = y.select("b", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("o"), F.col("y").alias("data"), none.alias("at"))
        rows = rows.unionByName(own.unionByName(rim).withColumn("pool", no_pool))
        moves = _by_block(rows, "kind", "o").mapInArrow(_move(nodes, dim, params, step, k, per_weight), MOVE)
        held = y.select("b", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("o"), F.col("y").alias("data"), F.col("alias").alias("at"), none.alias("drawn"))
        last, y = y, stored(_by_block(held.unionByName(moves), "kind", "o").mapInArrow(_apply(dim), PLACE), "embedding")
        dropped(last)
    return keep(y.join(parts.select("b", "ids"), "b").select("y", "ids").mapInArrow(_unpacked(dim), out))


def embed(edges: DataFrame, params: EmbedderParams = EmbedderParams()) -> DataFrame:  # noqa: B008
    """(id, coords) of a graph in one step: diffusion-map (or random) start in a box, kernel, epochs."""
    kernel = keep(proba_edges(edges, params.scale_rho, params.beta))
    return optimise(kernel, initial_embedding(edges, params), params, keep(hubness(edges)) if params.hubness_weighting else None)


def initial_embedding(edges: DataFrame, params: EmbedderParams = EmbedderParams()) -> DataFrame:  # noqa: B008
    """(id, coords) that ``embed`` starts from: the diffusion map, or random points, in a box."""
    if params.dmap_init:
        first = dmap_embed(edges, DiffusionParams(params.asked_dim, alfa=0.5, beta=-0.1, t=5.0, gnbn=12))
        return data_box(first, params.asked_dim, 10.0)
    return random_init(edges.select(F.col("src").alias("id")).distinct(), params.asked_dim, 10.0, params.seed)


def hierarchical_embed(small: DataFrame, proj: DataFrame, large: DataFrame, params: EmbedderParams = EmbedderParams()) -> DataFrame:  # noqa: B008
    """(id, coords): the upper graph first with more epochs, then all points from where their upper point is."""
    top = embed(small, params.with_(nb_grad_batch=params.grad_factor * params.nb_grad_batch, grad_step=1.0, hierarchy_layer=0))
    median = proj.agg(F.percentile("dist", F.lit(0.5)).alias("median"))
    dim = params.asked_dim
    near = proj.join(top.select(F.col("id").alias("upper_id"), F.col("coords").alias("c")), "upper_id").join(F.broadcast(median), how="cross")
    spread = F.sqrt(F.when(F.col("median") > 0, F.col("dist") / F.col("median")).otherwise(0.0) / dim)
    normal = [F.sqrt(-2 * F.log((F.pmod(F.xxhash64("id", F.lit(params.seed), F.lit(2 * j)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1))) * F.cos(2 * np.pi * F.pmod(F.xxhash64("id", F.lit(params.seed), F.lit(2 * j + 1)), F.lit(1 << 30)) / float(1 << 30)) for j in range(dim)]
    jitter = [F.greatest(F.least(spread * z, F.lit(2.0)), F.lit(-2.0)) for z in normal]
    start = near.select("id", F.array(*[F.col("c")[j] + jitter[j] for j in range(dim)]).alias("coords"))
    return optimise(keep(proba_edges(large, params.scale_rho, params.beta)), start, params, keep(hubness(large)) if params.hubness_weighting else None)
