"""Similarity join of documents on word n-grams, by token-combination prefixes.

Documents link when the Jaccard similarity of their sets of shingles reaches a
threshold.  Two such sets share at least two of the tokens in their extended
prefixes: the first ``n - ceil(t * n) + 2`` tokens in one order of all tokens.
The order puts frequent tokens last.  Rare tokens of a prefix are indexed alone,
frequent ones only in pairs; documents that share a key are candidates, and are
pruned by how many prefix tokens they share before exact verification.

Groups of copies never become pairs.  Texts with equal sets are one class.
Near copies are gathered into families around popular classes; each is compared
with its head, and index keys count only across families.  Inside a family,
tokens that most of its classes have are its core, the most frequent class of
tokens: two classes are told apart by their differences from it, so they are
joined on the few tokens by which they differ (see ``inside_families``).

Steps: scan for classes and prefixes in hash order; families; frequent tokens
(those in over ``frequent`` family heads); scan for final prefixes; candidates;
verification of whole sets; differences inside families; components.

Definitions:

* Words are runs of bytes but space and 0x09-0x0D, A-Z lower-cased; a text with
  fewer words than the shingle has one shingle, of all; null, empty and blank
  texts have none and are linked with nothing.
* Tokens are 64-bit hashes of shingles; classes are named by 64 bits of a hash
  of their set.
* component_id is the smallest doc_id reachable, the document's own included.
  Rows that repeat give equal rows; a null doc_id counts as no id.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_batches, in_sieve, join_hot, materialise, release, row_key, same, sieve, table
from .graph import components
from .short_keys import SHORT, dealt, shard_bits, short


def prefix_length(n: int, threshold: Fraction) -> int:
    """Tokens of a set of ``n`` of which a similar set must share one, and one more."""
    return min(n, n - ceil(threshold * n) + 2)


def _class(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)), pa.array(flat))


def _scan(docs: DataFrame, size: int, pick, columns: str, build, batch_bytes: int = 1 << 20) -> DataFrame:
    """Run ``build(sets)`` over the sets of each batch; doc_id, th, node, n come first."""

    def run(batches):
        for b in arrow_batches(batches, batch_bytes):
            got = shingles.sets([(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()], size)
            keep = [i for i, s in enumerate(got) if len(s)] if pick else list(range(len(got)))
            at = pa.array(keep, pa.int64())
            kept = [got[i] for i in keep]
            node = pa.array([_class(s) if len(s) else None for s in kept], pa.int64())
            n = pa.array([len(s) for s in kept], pa.int64())
            more = build(kept)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), node, n, *more.values()], ["doc_id", "th", "node", "n", *more])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, node long, n long{columns}")


def _five_bytes(tokens: np.ndarray) -> bytes:
    return short(tokens).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _from_five(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view(">u8").ravel().astype(np.uint64)


def classes_of(docs: DataFrame, size: int, threshold: Fraction, lowest: int = 12) -> DataFrame:
    """(doc_id, th, node, n, lowest, prefix) of every document.

    lowest: its smallest tokens; prefix: the prefix in hash order, a quarter
    longer, five bytes a token.
    """
    build = lambda sets: {"lowest": _lists([s[:lowest] for s in sets]), "prefix": pa.array([_five_bytes(s[: prefix_length(len(s), threshold) * 5 // 4 + 8]) for s in sets], pa.binary())}
    return _scan(docs, size, False, ", lowest array<long>, prefix binary", build)


def families(classes: DataFrame, threshold: Fraction, agree: int = 3) -> DataFrame:
    """(head, node): classes that look like near copies of a popular one, by their lowest tokens; ``classes``: node, n, lowest.

    The head of a token is the class whose lowest tokens are the commonest: of
    edited copies of one text, one that was not edited there.  Any choice gives
    the same result.
    """
    low = classes.select("node", "n", F.explode("lowest").alias("token"))
    common = low.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    low = materialise(low.join(common, "token"), "lowest")
    known = low.groupBy("node").agg(F.sum("m").alias("known"))
    heads = materialise(low.join(known, "node").groupBy("token").agg(F.max(F.struct("known", "node", "n")).alias("h")), "heads")
    num, den = threshold.numerator, threshold.denominator
    sized = (F.col("h.n") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("h.n") * num)
    near = low.join(heads, "token").where((F.col("h.node") != F.col("node")) & sized)
    found = materialise(near.groupBy(F.col("h.node").alias("head"), "node").count().where(F.col("count") >= agree).select("head", "node"), "families")
    release(low, heads)
    return found


def frequent_tokens(classes: DataFrame, family: DataFrame, over: int, most: int = 1 << 20) -> np.ndarray:
    """Sorted short tokens in the prefixes of over ``over`` classes, near copies left aside; ``classes``: node, prefix.

    At most ``most`` are taken (the limit of what is shipped, 8 MB): beyond it the
    limit of the frequency doubles.  Any choice gives the same result.
    """
    heads = classes.join(family.select("node").distinct(), "node", "left_anti").select("prefix")
    bits = shard_bits(classes.agg(F.sum(F.length("prefix"))).first()[0] // 5 if not classes.isEmpty() else 0)

    def deal(batches):
        for b in arrow_batches(batches, 4 << 20, "prefix"):
            got = np.sort(_from_five(b"".join(b.column(0).to_pylist())))
            shard, low = dealt(got, bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(low, pa.binary())], ["shard", "low"])

    def count(t: pa.Table) -> pa.Table:
        low = np.sort(np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint32))
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        m = np.diff(np.r_[first, len(low)])
        often = m > over
        token = (np.uint64(t.column("shard")[0].as_py()) << np.uint64(SHORT - bits)) + low[first[often]]
        return pa.table({"token": pa.array(token.astype(np.int64)), "m": pa.array(m[often])})

    counts = materialise(heads.mapInArrow(deal, "shard int, low binary").groupBy("shard").applyInArrow(count, "token long, m long"), "frequent")
    while counts.where(F.col("m") > over).count() > most:
        over *= 2
    often = counts.where(F.col("m") > over).select("token").toArrow().column(0).to_numpy()
    release(counts)
    return np.sort(often.astype(np.uint64))


def postings(docs: DataFrame, size: int, threshold: Fraction, frequent: np.ndarray) -> DataFrame:
    """(doc_id, th, node, n, f, singles, pairs, reach): the index keys of each document; f: frequent tokens in its prefix.

    reach: for each pair the tokens that a set shares with another at most, if these two are the first that they share.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def build(sets):
        often = shipped.value
        singles, pairs, reach, f = [], [], [], []
        every = short(np.concatenate([*sets, np.zeros(0, np.uint64)]))
        if len(often):
            at = np.minimum(np.searchsorted(often, every), len(often) - 1)
            hot = often[at] == every
        else:
            hot = np.zeros(len(every), bool)
        begin = 0
        for s in sets:
            h = hot[begin : begin + len(s)]
            begin += len(s)
            p = prefix_length(len(s), threshold)
            rare = s[~h][:p]
            common = s[h][: p - len(rare)]
            a, b = np.triu_indices(len(common), 1)
            singles.append(rare)
            pairs.append(shingles.mix(common[a] * shingles.MULT + common[b]) if len(a) else common[:0])
            reach.append((len(s) - len(rare) - b + 1).astype(np.uint64))
            f.append(len(common))
        return {"f": pa.array(f, pa.int32()), "singles": _lists(singles), "pairs": _lists(pairs), "reach": _lists(reach)}

    return _scan(docs, size, True, ", f int, singles array<long>, pairs array<long>, reach array<long>", build)


def shared_keys(keys: DataFrame) -> DataFrame:
    """(token): the short index keys that classes of two families have; ``keys``: family, singles, pairs.

    Keys move as five bytes with four of the family's hash; of a family that
    has a key many times in a batch, one moves.
    """
    bits = shard_bits(keys.agg(F.sum(F.size("singles") + F.size("pairs"))).first()[0] or 0)

    def deal(batches):
        for b in arrow_batches(batches, 4 << 20, "singles"):
            own = np.concatenate([np.diff(b.column(k).offsets.to_numpy()) for k in (1, 2)])
            family = np.repeat(np.tile(b.column(0).to_numpy() & 0xFFFFFFFF, 2), own)
            every = short(np.concatenate([b.column(k).flatten().to_numpy() for k in (1, 2)]).view(np.uint64))
            order = np.lexsort((family, every))
            every, family = every[order], family[order].astype(np.uint32)
            first = np.r_[True, (every[1:] != every[:-1]) | (family[1:] != family[:-1])] if len(every) else np.zeros(0, bool)
            shard, low, who = dealt(every[first], bits, family[first])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(low, pa.binary()), pa.array(who, pa.binary())], ["shard", "low", "who"])

    def meet(t: pa.Table) -> pa.Table:
        low, who = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32) for c in ("low", "who"))
        order = np.argsort(low, kind="stable")
        low, who = low[order], who[order]
        again = np.flatnonzero((low[1:] == low[:-1]) & (who[1:] != who[:-1]))
        token = (np.uint64(t.column("shard")[0].as_py()) << np.uint64(SHORT - bits)) + np.unique(low[again])
        return pa.table({"token": pa.array((token << np.uint64(64 - SHORT)).view(np.int64))})

    moved = keys.select(F.xxhash64("family").alias("family"), "singles", "pairs").mapInArrow(deal, "shard int, low binary, who binary")
    return moved.groupBy("shard").applyInArrow(meet, "token long")


def merged(p: DataFrame, large: int) -> DataFrame:
    """(family, into): families to be taken as one, as two keys at least join one with ``large`` classes or more of the other; ``p``: node, family, key.

    Any choice of families gives the same result; a class beside a large family
    would else make a pair with each of its classes.
    """
    crowd = materialise(p.groupBy("key", "family").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= large).select("key", F.col("family").alias("crowd")), "crowds")
    own = p.select("key", "family").distinct()
    near = own.join(crowd, "key").where("family <> crowd").groupBy("family", "crowd").agg(F.count_distinct("key").alias("keys")).where("keys > 1")
    found = components(near.select(F.col("family").alias("a"), F.col("crowd").alias("b"))).select(F.col("node").alias("family"), F.col("component").alias("into"))
    # A row that changes nothing (into: null) keeps the table from being empty, so that the plan is alike at every size.
    # Its family is no null: the join would filter a null out, find an empty table and be left out of the plan.
    nobody = found.sparkSession.range(1).select(F.col("id").alias("family"), F.lit(None).cast("long").alias("into"))
    return found.unionByName(nobody.join(found.where("family = 0").select("family"), "family", "left_anti"))


def candidates(keys: DataFrame, threshold: Fraction, large: int = 64) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes of different families that may be similar, and ``merged`` families; ``keys``: node, family, n, f, singles, pairs, reach.

    The first token that two similar sets share is a single, or their first two
    are a pair, which then has the reach: other pairs of tokens need not meet.
    """
    found = sieve(shared_keys(keys), "token")
    head = ["node", "family", "n", "f"]
    single = keys.select(*head, F.explode("singles").alias("key"), F.col("n").alias("reach"), F.lit(1).alias("w"))
    paired = keys.where(F.size("pairs") > 0).select(*head, F.explode(F.arrays_zip("pairs", "reach")).alias("p")).select(*head, F.col("p.pairs").alias("key"), F.col("p.reach").alias("reach"), F.lit(0).alias("w"))
    p = materialise(in_sieve(single.unionByName(paired), "key", found).where("_in").select(*head, "key", "reach", "w"), "postings")
    same_family = materialise(merged(p, large), "merged")
    p = p.join(same_family, "family", "left").withColumn("family", F.coalesce("into", "family")).drop("into")
    t, o = threshold, threshold / (1 + threshold)
    x, y = p.alias("x"), p.alias("y")
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.family") != F.col("y.family")) & (F.col("x.node") < F.col("y.node"))
    sized = (F.col("x.n") * t.denominator >= F.col("y.n") * t.numerator) & (F.col("y.n") * t.denominator >= F.col("x.n") * t.numerator)
    far = F.least("x.reach", "y.reach") * o.denominator >= (F.col("x.n") + F.col("y.n")) * o.numerator
    pairs = x.join(y, meets & sized & far).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.sum("x.w").alias("c"), *[F.first(f"{s}.{k}").alias(f"{k}{s}") for s in "xy" for k in ("n", "f")])
    rest = lambda s: F.col(f"n{s}") - F.least(f"n{s}", F.col(f"n{s}") - F.ceil(F.col(f"n{s}") * t.numerator / t.denominator - 1e-9) + 2)
    most = F.col("c") + F.least("fx", "fy") + F.greatest(rest("x"), rest("y"))
    return pairs.where(most * o.denominator >= (F.col("nx") + F.col("ny")) * o.numerator).select("a", "b"), same_family


def whole_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, family: DataFrame, size: int) -> DataFrame:
    """(family, node, n, tokens binary) of the classes in ``nodes``, from the whole text of one document each; ``family``: node, component."""
    one = classes.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("k"))
    one = one.join(family, "node", "left")
    one = materialise(one.select("k.doc_id", "k.th", F.xxhash64("k.doc_id", "k.th").alias("row"), F.col("component").alias("family")), "readers")
    keyed = docs.select("text", *row_key()).withColumn("row", F.xxhash64("doc_id", "th"))
    near = in_sieve(keyed, "row", sieve(one, "row")).where("_in").drop("_in")
    picked = near.alias("d").join(one.alias("o"), same("d", "o", "doc_id", "th", "row")).select("d.doc_id", "d.th", "d.row", "d.text", "o.family").dropDuplicates(["doc_id", "th", "row"])
    picked = picked.select(F.col("family").alias("doc_id"), "text")
    build = lambda sets: {"tokens": pa.array([s.tobytes() for s in sets], pa.binary())}
    return _scan(picked, size, True, ", tokens binary", build).select(F.col("doc_id").alias("family"), "node", "n", "tokens")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, exactly."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([u, v])
                both.sort()
                k = int((both[1:] == both[:-1]).sum())
                good.append(k * den >= (len(u) + len(v) - k) * num)
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _spread(members: DataFrame, few: DataFrame, parts: int = 32) -> DataFrame:
    """Join ``members`` (node, family) with one row a family, a large family dealt over ``parts`` tasks."""
    salted = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return members.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")).join(salted, ["family", "_part"]).drop("_part")


def consensus(members: DataFrame) -> DataFrame:
    """(family, core binary): the sorted tokens in over half of a family's classes; ``members``: family, tokens.

    Counts are summed per batch before they are shuffled.  A core holds at most
    twice as many tokens as the mean class of its family.
    """

    def count(batches):
        for b in arrow_batches(batches, 4 << 20, "tokens"):
            lists = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            if not lists:
                continue
            pairs = np.empty(sum(map(len, lists)), [("f", np.int64), ("t", np.int64)])
            pairs["f"] = np.repeat(b.column(0).to_numpy(), [len(x) for x in lists])
            pairs["t"] = np.concatenate(lists).view(np.int64)
            pairs.sort(order=("f", "t"))
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            often = np.diff(np.r_[first, len(pairs)])
            yield pa.RecordBatch.from_arrays([pa.array(pairs["f"][first]), pa.array(pairs["t"][first]), pa.array(often)], ["family", "token", "m"])

    def gather(batches):
        for b in batches:
            packed = [np.sort(np.array(x, np.int64).view(np.uint64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["family", "core"])

    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    counts = members.select("family", "tokens").mapInArrow(count, "family long, token long, m long").groupBy("family", "token").agg(F.sum("m").alias("m")).where("m > 1")
    core = counts.join(sizes, "family").where("2 * m > size").groupBy("family").agg(F.collect_list("token").alias("core"))
    whole = sizes.join(core, "family", "left").select("family", F.coalesce("core", F.array().cast("array<long>")).alias("core"))
    return whole.mapInArrow(gather, "family long, core binary")


def differences(members: DataFrame, cores: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, family, n, g, d, diff): how each class differs from its family's core.

    diff: the tokens that only the class has, then those that only the core has.
    Two classes whose g add up to s are similar when, and only when, their
    diffs share at least s tokens.
    """
    num, den = threshold.numerator, threshold.numerator + threshold.denominator

    def run(batches):
        for b in arrow_batches(batches, 4 << 20, "tokens"):
            diffs, g = [], []
            for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                own, core = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                extra, missing = np.setdiff1d(own, core, True), np.setdiff1d(core, own, True)
                diffs.append(np.concatenate([extra, missing]))
                # twice the denominator times (t / (1 + t) * n + missing - core / 2), an integer
                g.append(2 * num * len(own) + den * (2 * len(missing) - len(core)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(g, pa.int64()), pa.array([len(x) for x in diffs], pa.int64()), _lists(diffs)], ["node", "family", "n", "g", "d", "diff"])

    both = _spread(members, cores).select("node", "family", "n", "tokens", "core")
    return both.mapInArrow(run, "node long, family long, n long, g long, d long, diff array<long>")


def _components(members: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def rarest_first(diffs: DataFrame, over: int = 4, most: int = 1 << 19) -> DataFrame:
    """``diffs`` (family, diff, ...) with each diff sorted by how many diffs of the family have the token, the rarest first.

    Tokens in at most ``over`` diffs count as equally rare.  At most ``most``
    counts are shipped (12 MB): beyond it ``over`` doubles.  Any order that a
    family's diffs have in common gives the same result.
    """
    counts = diffs.select("family", F.explode("diff").alias("token")).groupBy("family", "token").agg(F.count(F.lit(1)).alias("m"))
    counts = materialise(counts.where(F.col("m") > over), "common")
    while counts.where(F.col("m") > over).count() > most:
        over *= 2
    often = counts.where(F.col("m") > over).select("family", "token", "m").toArrow()
    release(counts)
    family, token, m = (c.to_numpy() for c in often.columns)
    order = np.lexsort((token, family))
    shipped = diffs.sparkSession.sparkContext.broadcast((family[order], token[order], m[order]))

    def run(batches):
        family, token, m = shipped.value
        for b in arrow_batches(batches, 1 << 20, "diff"):
            at = b.schema.get_field_index("diff")
            own = b.column("family").to_numpy()
            low, high = np.searchsorted(family, own), np.searchsorted(family, own, "right")
            done = []
            for i, x in enumerate(b.column(at)):
                x = x.values.to_numpy()
                known = token[low[i] : high[i]]
                k = np.searchsorted(known, x)
                hit = k < len(known)
                hit[hit] = known[k[hit]] == x[hit]
                rank = np.zeros(len(x), np.int64)
                rank[hit] = m[low[i] : high[i]][k[hit]]
                done.append(x[np.lexsort((x, rank))].view(np.uint64))
            yield b.set_column(at, "diff", _lists(done))

    return diffs.mapInArrow(run, diffs.schema)


def inside_families(sets: DataFrame, family: DataFrame, links: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (a, b) that, with ``links``, connect all similar classes of each family.

    A pair needs g(x) + g(y) shared differences from the core.  Where that is
    none, both are similar to the class of the smallest g, and a star round it
    joins them.  Other pairs share one of the first d - s + 1 differences, the
    rarest first, s the fewest that the pair must share; index keys are made for
    the fewest that the class must share with any.  Only pairs of which one is
    outside its family's largest component, and of different components, are
    looked at.
    """
    m = materialise(_components(family.withColumnRenamed("component", "family"), links), "members")
    apart = m.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("family")
    apart = apart.select(F.xxhash64("family").alias("key"))
    m = in_sieve(sets.where("family is not null").withColumn("key", F.xxhash64("family")), "key", sieve(apart, "key")).where("_in").select("node", "family", "n", "tokens")
    diffs = materialise(differences(m, materialise(consensus(m), "cores"), threshold), "differences")
    centre = diffs.groupBy("family").agg(F.min(F.struct("g", "node")).alias("c")).select("family", F.col("c.g").alias("least"), F.col("c.node").alias("centre"))
    star = _spread(diffs.select("node", "family", "g"), centre).where("g + least <= 0 AND node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    star = materialise(star, "stars")
    now = _components(diffs, links.unionByName(star))
    counts = now.groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"), F.min("g").alias("g"))
    main = counts.groupBy("family").agg(F.max(F.struct("size", "component")).alias("l"), F.min("g").alias("least")).select("family", F.col("l.component").alias("main"), "least")
    outside = counts.join(main, "family").where("component <> main").groupBy("family", "main", "least").agg(F.min("g").alias("loose"))
    unit = 2 * (threshold.numerator + threshold.denominator)
    now = _spread(now, outside).withColumn("out", F.col("component") != F.col("main"))
    now = materialise(now.select("node", "family", "component", "out", "n", "g", "d", "diff", *[F.greatest(F.lit(1), F.ceil((F.col("g") + F.col(k)) / unit)).alias(s) for k, s in (("least", "s_all"), ("loose", "s_out"))]), "apart")
    now = materialise(rarest_first(now), "ordered")
    keys = lambda s: now.where(F.col(s) <= F.col("d")).select("node", "family", "component", "out", "g", "d", F.posexplode(F.slice("diff", F.lit(1), (F.col("d") - F.col(s) + 1).cast("int"))).alias("at", "key"))
    x, y = keys("s_all").where("out").alias("x"), keys("s_out").alias("y")
    meets = (F.col("x.family") == F.col("y.family")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & (~F.col("y.out") | (F.col("x.node") < F.col("y.node")))
    need = F.ceil((F.col("x.g") + F.col("y.g")) / unit)
    # diffs of a family are in one order: all that a pair shares lies from the first shared difference on, in both
    first = need <= F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at"))
    pairs = x.join(y, meets & first).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), need.alias("need")).distinct()
    pairs = materialise(pairs, "leftovers")
    left, right = (now.select(F.col("node").alias(k), F.col("diff").alias(f"d{k}")) for k in "ab")
    found = pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("da", "db")) >= F.col("need")).select("a", "b")
    return star.unionByName(materialise(found, "verified"))


def grouped(docs: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5), frequent: int = 16) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, component) of the rows of ``docs`` (doc_id, text) with shingles, and (doc_id, th, n) of those without."""
    docs = docs.select("doc_id", "text")
    every = materialise(classes_of(docs, size, threshold), "classes")
    classes = every.where("n > 0")
    near = families(classes.groupBy("node", "n").agg(F.first("lowest").alias("lowest")), threshold)
    members = near.groupBy("node").agg(F.min("head").alias("head"))
    family = components(near.select(F.col("head").alias("a"), F.col("node").alias("b")))
    often = frequent_tokens(classes.groupBy("node").agg(F.first("prefix").alias("prefix")), members, frequent)
    ids = materialise(every.drop("lowest", "prefix"), "ids")
    release(every)
    keys = postings(docs, size, threshold, often).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "f", "singles", "pairs", "reach")])
    keys = materialise(keys.join(family, "node", "left").select("node", F.coalesce("component", "node").alias("family"), "n", "f", "singles", "pairs", "reach"), "keys")
    pairs, same_family = candidates(keys, threshold)
    pairs = materialise(pairs.unionByName(near.select(F.col("head").alias("a"), F.col("node").alias("b"))).distinct(), "candidates")
    family = keys.select("node", "family").join(same_family, "family", "left").withColumn("component", F.coalesce("into", "family"))
    family = family.join(family.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("component"), "component")
    family = materialise(family.select("node", "component"), "families")
    release(keys)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(family.select("node")).distinct()
    sets = materialise(whole_sets(docs, nodes, ids.where("n > 0"), family, size), "sets")
    links = materialise(verified(pairs, sets, threshold), "verified")
    found = components(links.unionByName(inside_families(sets, family, links, threshold)))
    release(sets)
    named = ids.where("n > 0").join(found, "node", "left").select("doc_id", "th", "n", F.coalesce("component", "node").alias("component"))
    return named, ids.where("n = 0").select("doc_id", "th", "n")


def join(docs: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5), frequent: int = 16, large: int = 1000) -> DataFrame:
    """(doc_id, th, n_shingles, component_id) of every row of ``docs`` (doc_id, text); components of over ``large`` rows are dealt over tasks."""
    named, bare = grouped(docs, size, threshold, frequent)
    named = materialise(named, "named")
    smallest = materialise(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "smallest")
    done = join_hot(named, smallest.drop("size"), "component", smallest.where(F.col("size") > large), ["doc_id", "th"])
    done = done.select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id")
    return done.unionByName(bare.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Rows with one id are told apart by their texts, the smallest hash first; a
    null id comes after all others.  All rows without shingles stay.  Of rows
    with one id and equal texts one stays.  Other columns may have any names.
    Only texts of rows that may have to go are shuffled.
    """
    named, bare = grouped(docs, **how)
    every = materialise(named.select("doc_id", "th", "component").unionByName(bare.select("doc_id", "th", F.lit(None).cast("long").alias("component"))), "named")
    first = every.where("component is not null").groupBy("component").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "th")).alias("k")).select("k.doc_id", "k.th")
    kept = first.unionByName(every.where("component is null").select("doc_id", "th")).select("doc_id", "th", F.xxhash64("doc_id", "th").alias("key"))
    kept = materialise(kept, "kept")
    rows = every.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("m")).select("doc_id", "th", "m", F.xxhash64("doc_id", "th").alias("key"))
    rows = rows.join(kept.groupBy("key").agg(F.first(F.lit(True)).alias("stays")), "key", "left")
    doubtful = materialise(sieve(rows.where("stays is null or m > 1"), "key"), "doubtful")
    packed = docs.select(F.struct("*").alias("row"), *row_key())
    packed = in_sieve(packed.withColumn("key", F.xxhash64("doc_id", "th")), "key", doubtful)
    asked = packed.where("_in").alias("d").join(kept.alias("k"), same("d", "k", "doc_id", "th", "key"), "left_semi").dropDuplicates(["doc_id", "th", "key"])
    return packed.where("not _in").select("row.*").unionByName(asked.select("row.*"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), size=4, threshold=Fraction(85, 100)).select("doc_id", "n_shingles", "component_id")
