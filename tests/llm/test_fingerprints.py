"""Spot signatures against brute force, and on odd inputs."""

import hashlib
import random
from collections import Counter

import pytest
import regex
import xxhash

from tessera.llm import fingerprints as fp

MASK = 0xFFFFFFFF
SCHEMA = "doc_id long, text string, key string, part string, own string, next string, starts string"
ODD = [None, "", "   \n\t", "a", "the", "Zoë Åß 日本語 \U0001f600", "!?", "the cat " * 90, " ".join(f"w{i % 977}" for i in range(2_000)), "x" * 5000, "İSTANBUL ﬁ"]


def hashed(seed, *values):
    """Spark's xxhash64 of strings and longs; null values leave the hash as it is."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=seed & (2**64 - 1)).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def brute(text):
    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())
    if not words:
        return {hashed(42, text) & MASK} if text else set()
    code = lambda w: (((hashed(42, w) << 1) + 2**63) % 2**64 - 2**63) | (w in fp.COMMON)
    codes = [code(w) for w in words]
    spots, last = [], -fp.GAP
    for i, w in enumerate(words):
        if w in fp.COMMON:
            last = i
        if w in fp.COMMON or i - last >= fp.GAP:
            spots.append(hashed(42, codes[i], *[c for c in codes[i + 1 :] if not c & 1][: fp.CHAIN]) & MASK)
    return {s if k == 0 else hashed_copy(s, k + 1) for s, n in Counter(spots).items() for k in range(n)}


def hashed_copy(s, k):
    """The copy's number is an int in Spark, which is hashed as four bytes."""
    h = xxhash.xxh64(s.to_bytes(8, "little"), seed=42).intdigest()
    return xxhash.xxh64(k.to_bytes(4, "little"), seed=h).intdigest() & MASK


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, *["clash"] * 5) for i, t in enumerate(texts)], SCHEMA)


def test_signatures_against_brute_force(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["the", "of", "und", "le", "Cat", "dog", "stone", "rivière", "x1", "é", "walks", "sees", "tree"])
    texts = [rnd.choice([" ", ", ", ".\n"]).join(word() for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts += [" ".join(f"v{i}" for i in range(50)), "the " * 40, *[t for t in ODD if t]]
    got = fp.with_signatures(docs_of(spark, texts), "text", "sigs").select("doc_id", "sigs").collect()
    for r in got:
        assert r["sigs"] == sorted(set(r["sigs"]))
        assert set(r["sigs"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]][:80]


def wanted(rows):
    """The contract by plain Python, for rows (doc_id, text) with ids that differ."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        a, b, c = brute(t), brute(e), brute(n)
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y) if x and y else 0.0
        sizes = lambda x, y: bool(x and y) and min(len(x), len(y)) < fp.FLOOR * max(len(x), len(y))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{s:08x}" for s in sorted(a)), "".join(f"{s:08x}" for s in sorted(b)), like(a, b), like(a, c), sizes(a, b), sizes(a, c))
    return out


@pytest.mark.parametrize("rows", [1, 4, 64])
def test_query_against_brute_force(spark, tmp_path, rows, monkeypatch):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["the", "of", "and", *(f"word{i}" for i in range(300))])
    texts = [*ODD, *(" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(60))]
    texts += [texts[20], texts[20]]
    ids = [None, *rnd.sample(range(-500, 500), len(texts) - 1)]
    spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, key string, own string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fp.with_next, "__defaults__", (rows,))
    got = {r["doc_id"]: r for r in fp.op12_fingerprints(spark, str(tmp_path)).collect()}
    want = wanted(zip(ids, texts, strict=True))
    assert got.keys() == want.keys()
    for i, (n, sha, a, b, near, after, far_edit, far_next) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, a, b)
        assert r["near_edited"] == pytest.approx(near) or far_edit and r["near_edited"] in (0.0, pytest.approx(near))
        assert r["near_next"] == pytest.approx(after) or far_next and r["near_next"] in (0.0, pytest.approx(after))


def test_repeated_rows_ties_and_empty_tables(spark, tmp_path):
    rows = [(5, "same text of it"), (5, "same text of it"), (5, "other text of it"), (None, "no id"), (None, None), (9, "the end")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.with_next(d, 1).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t or "") for i, t in rows)
    following = {(r["doc_id"], r["text"]): r["next"] for r in got if r["doc_id"] != 5}
    assert following[9, "the end"] in ("", "no id") and {following[None, ""], following[None, "no id"]} & {"", "no id"}
    assert Counter(r["next"] for r in got) == Counter(t or "" for _, t in rows)
    assert [(r["text"], r["next"]) for r in fp.with_next(d.where("doc_id = 9")).collect()] == [("the end", "the end")]
    d.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert fp.op12_fingerprints(spark, str(tmp_path)).count() == 0
    assert {r["doc_id"]: r["n_signatures"] for r in fp.fingerprints(docs_of(spark, [None, "", "!", "the cat"])).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_near_pairs_against_brute_force(spark, least):
    rnd = random.Random(3)
    sets = {}
    for i in range(150):
        s = set(rnd.choice(list(sets.values()))) if i > 20 and rnd.random() < 0.7 else set(rnd.sample(range(10_000), rnd.randint(1, 60)))
        for _ in range(rnd.randint(0, 8)):
            s ^= {rnd.randrange(10_000)}
        sets[i] = s
    sets |= {200: sets[3], 201: sets[3], 202: set()}
    d = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, sigs array<long>")
    first = {}
    for i, s in sorted(sets.items()):
        if s:
            first.setdefault(frozenset(s), i)
    want = {(a, b): len(x & y) / len(x | y) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) >= least * len(x | y)}
    got = {(r["a"], r["b"]): r["likeness"] for r in fp.near_pairs(d, least).collect()}
    assert len(want) > 20 and got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
