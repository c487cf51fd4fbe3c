"""The corpus operators against brute force, round trips and held-out rows, and on odd inputs."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, language_id, ngram_join, quality, secret_scan, sentence_pieces, substring_dedup, token_counts, topk_search, toxicity
from tessera.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, score string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [None, "", "   \n\t", "a", "Zoë Åß 日本語 \U0001f600", "same words here for all", "same words here for all", LONG, "x" * 5000, "\0\x01", "İSTANBUL ﬁ"]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", "clash") for i, t in enumerate(texts, first)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    df = docs_of(spark, ODD)
    return df.unionByName(df.where("doc_id = 5")).unionByName(docs_of(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long"))).persist()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, ["x"]).where("false")


def brute_spans(text):
    text = text or ""
    out = []
    for k, r in enumerate(secret_scan.BASE):
        for m in re.finditer(r.pattern, text, re.IGNORECASE | re.ASCII if r.any_case else 0):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end(), r.kind))
    return ",".join(f"{kind}:{a}:{b}" for a, k, b, kind in sorted(out))


def test_secrets_against_brute_force(spark):
    rnd = random.Random(1)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", ": ", "=", '"', " ", "é", "AKIA" + "Q" * 16, "AKIA", "abcdef0123456789", "deadbeef", "x1Y2z3A4b5C6d7", "short", "\n", "passwd=abcdefghijkl", "token: token: abcdefghijklmnop"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(150)] + ODD
    got = secret_scan.scan(docs_of(spark, texts), secret_scan.BASE).select("row.doc_id", secret_scan.span_string(F.col("spans"), secret_scan.BASE).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_trigram_queries():
    q = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.BASE + secret_scan.MORE}
    assert q["hex"] == secret_scan.TRUE and {"tok", "oke", "ken"} in q["assign"] and q["access"] == {frozenset({"aki", "kia"})}


def test_redaction(spark):
    d = docs_of(spark, ["é password = abcdefghijkl end", None, "clean"])
    got = {r["doc_id"]: r for r in secret_scan.redact(d).collect()}
    assert got[0]["text"] == "é [SECRET] end" and got[1]["text"] is None and got[2]["text"] == "clean" and got[0]["n_chars"] == 14


INTERNAL = ["th", "_th", "row", "key", "_key", "_in", "_part", "_bits", "part", "bits", "spans", "_spans", "rules", "clean", "any", "node", "component", "n", "d", "k", "c", "m"]


def test_columns_of_any_name_stay_as_they_are(spark):
    texts = [" ".join(f"a{i}" for i in range(40)), " ".join(f"a{i}" for i in range(40)) + " end", "password = abcdefghijkl", "", None]
    d = docs_of(spark, texts).select("doc_id", "text", "lang", "n_chars", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in INTERNAL])
    bench = spark.createDataFrame([(1, "never there")], "item_id long, text string")
    runs = {
        "redact": (secret_scan.redact(d), [0, 1, 2, 3, 4]),
        "keep_one": (ngram_join.keep_one(d), [0, 2, 3, 4]),
        "keep_identified": (language_id.keep_identified(d, language_id.train(d)), [0, 1, 2]),
        "clean": (decontaminate.clean(d, bench), [0, 1, 2, 3, 4]),
    }
    for name, (got, ids) in runs.items():
        assert got.columns == d.columns, name
        rows = got.orderBy("doc_id").collect()
        assert [r["doc_id"] for r in rows] == ids, name
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in INTERNAL), name


def test_join_deals_hot_values_over_tasks(spark):
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("v"))
    few = rows.groupBy("v").agg(F.count(F.lit(1)).alias("m"))
    got = common.join_hot(rows, few, "v", few.where("m > 50"), ["id"], 4)
    assert got.count() == 500 and got.where("(v = 7) <> (m = 400)").count() == 0
    assert common.join_hot(rows, few, "v", few.where("false"), ["id"]).count() == 500


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((250, 4)), 1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [float("nan")] * 4), (903, [1.0])]
    v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e", 1024)
    got = topk_search.top_k(v.where("id % 100 = 0"), v, 5, query_block=2, shard_rows=40).orderBy("query_id", "rank").collect()
    q = np.floor(1024 * x).astype(np.int64)
    want = []
    for i in (0, 100, 200):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(250) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert [tuple(r) for r in got] == want
    assert topk_search.top_k(v.where("false"), v).count() == 0


def test_large_products_stay_exact():
    q = np.array([[2**30, 1]], np.int64)
    assert topk_search.tile(q, q, False)[0, 0] == 2**60 + 1


def brute_components(texts, size, num, den):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append(frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        old = list(label)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and den * len(a & sets[j]) >= num * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if old == label:
            break
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_ngram_join_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: f"v{rnd.randint(0, 60)}"
    passage = [word() for _ in range(25)]
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(70):
        t = list(base) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(0, 50))] + passage
        for _ in range(rnd.randint(0, 3)):
            if t:
                t[rnd.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [texts[0], texts[1], "", None, "One", "one", "two words"]
    got = ngram_join.join(docs_of(spark, texts), 3, Fraction(7, 10), frequent=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 3, 7, 10)


def test_ngram_join_of_edited_copies_without_their_original(spark):
    rnd = random.Random(11)
    word = lambda: f"u{rnd.randint(0, 5000)}"
    stems = [[word() for _ in range(90)] for _ in range(2)]
    stems.append([*stems[0][:70], *(word() for _ in range(20))])
    texts = []
    for i in range(120):
        t = list(stems[i % 3])
        for _ in range(rnd.choice([1, 1, 2, 2, 3, 5])):
            at = rnd.choice([3, 4, 20, rnd.randrange(len(t) - 1)])
            t[at : at + rnd.randint(0, 2)] = [word()] * rnd.randint(0, 2)
        texts.append(" ".join(t))
    got = ngram_join.join(docs_of(spark, texts), 4, Fraction(85, 100), frequent=4).collect()
    want = brute_components(texts, 4, 85, 100)
    assert 2 < len({c for _, c in want.values()}) < 110
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_rarest_first(spark):
    rnd = random.Random(5)
    rows = [(i, i % 3, rnd.sample(range(-20, 20), rnd.randint(0, 25))) for i in range(60)]
    often = Counter((f, t) for _, f, diff in rows for t in diff)
    d = spark.createDataFrame(rows, "node long, family long, diff array<long>")
    for over, most in ((4, 1 << 19), (0, 1 << 19), (1, 20)):
        got = {r["node"]: r["diff"] for r in ngram_join.rarest_first(d, over, most).collect()}
        limit = over
        while sum(m > limit for m in often.values()) > most:
            limit = limit * 2
        rank = lambda f, t: (often[f, t] if often[f, t] > limit else 0, t)  # noqa: B023, E731
        assert got == {i: sorted(diff, key=lambda t, f=f: rank(f, t)) for i, f, diff in rows}
    assert ngram_join.rarest_first(d.limit(0)).count() == 0


def test_keep_one_with_null_and_clashing_ids(spark):
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("a")), (None, ""), (5, text("c")), (5, text("d")), (5, ""), (5, text("c")), (7, text("c") + " end"), (3, text("b") + " end"), (9, None), (9, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(d).collect())
    assert got == Counter([(None, text("a")), (None, ""), (5, text("c")), (5, text("d")), (5, ""), (3, text("b") + " end"), (9, None), (9, " ")])


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_leaks(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{rnd.randint(0, 400)}" for _ in range(n))
    items = [text(n) for n in (15, 22, 40, 59, 130)] + ["tiny item", "", None]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [text(100) + " " + (items[i % 5].upper().replace(" ", ", ") if i < 5 else "") + " " + text(80) for i in range(10)] + ["a tiny item here", items[2].replace("w", "w", 1), "", None]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(spark, docs), b).collect()}
    assert got == {(i, i) for i in range(5)} | {(10, 5), (11, 2)}
    assert {r["doc_id"] for r in decontaminate.clean(docs_of(spark, docs), b).collect()} == {5, 6, 7, 8, 9, 12, 13}


def test_hamming_blocks_find_all_in_radius():
    rng = np.random.default_rng(2)
    items = decontaminate.Items([0], [" ".join(map(str, range(40)))], 0.8)
    fp = rng.integers(0, 2**63, 50, dtype=np.uint64)
    c = {"fp": fp, "index": items._index(fp)}
    near = fp.copy()
    for k in range(7):
        near ^= np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)
    w, f = items.near(c, near)
    assert set(range(50)) <= {int(a) for a, b in zip(w, f, strict=True) if a == b}


def test_leaks_in_short_batches():
    rnd = random.Random(14)
    items = [[f"v{rnd.randint(0, 5000)}" for _ in range(n)] for n in (2, 4, 9, 30, 80, 110, 300)]
    held = decontaminate.Items(list(range(len(items))), [" ".join(i) for i in items], 0.8)
    for n in (1, 3, 8, 40, 80, 110, 250):
        for doc in ([f"u{k}" for k in range(n)], *([*i, *["u"] * n] for i in items)):
            got = {i for _, i, *_ in held.search(*decontaminate.word_hashes([" ".join(doc)]))}
            assert got == {k for k, i in enumerate(items) if doc[: len(i)] == i}


def brute_leak(doc, item, size=5):
    grams = lambda w: Counter(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)])
    own, best = grams(item), (0.0, 0, 0)
    for a in range(1 - len(item), len(doc)):
        lo, hi = max(a, 0), min(a + len(item), len(doc))
        got = grams(doc[lo:hi])
        s = sum((own & got).values()) / sum((own | got).values())
        best = max(best, (s, -lo, -hi))
    return (best[0], -best[1], -best[2])


def test_edited_leaks_against_brute_force():
    rnd = random.Random(12)
    word = lambda: f"q{rnd.randint(0, 9000)}"
    items = [[word() for _ in range(n)] for n in (3, 5, 20, 59, 100, 100, 200) for _ in range(4)] + [["a", "b"] * 20, ["x"] * 30]
    texts = []
    for i in items * 4:
        t = list(i)
        at, run = rnd.randrange(max(1, len(t) - len(t) // 12)), len(t) // 14
        kind = rnd.randrange(4)
        t[at : at + (0 if kind == 1 else run)] = [] if kind == 2 else [word() for _ in range(run)]
        t = t[rnd.choice([0, 0, len(t) // 12]) :]
        texts.append([word() for _ in range(rnd.choice([0, 30]))] + t + [word() for _ in range(rnd.choice([0, 25]))])
    held = decontaminate.Items(list(range(len(items))), [" ".join(i) for i in items], 0.8)
    got = {(d, i): v for d, i, *v in held.search(*decontaminate.word_hashes([" ".join(t) for t in texts]))}
    want = {(d, i): b for d, t in enumerate(texts) for i, item in enumerate(items) if 2 * len(set(t) & set(item)) > len(set(item)) and (b := brute_leak(t, item))[0] >= 0.8}
    assert len(want) > 50 and got.keys() == want.keys()
    assert all(got[k] == [pytest.approx(v[0]), *v[1:]] for k, v in want.items())


def test_leaks_with_spread_edits_come_from_fingerprints():
    """Edits as far apart as they can be; every candidate comes from a fingerprint, and item-sized windows alone miss some."""
    rnd = random.Random(21)
    word = lambda: f"z{rnd.randint(0, 90000)}"
    items = [[word() for _ in range(n)] for n in (6, 9, 13, 14, 24, 33, 54, 77, 120, 260) for _ in range(3)] + [["on", "and"] * 15 + [word() for _ in range(20)], ["x"] * 12]
    texts = []
    for i in items:
        for edits in range(max(1, len(i) // 40), len(i) // 20 + 2):
            t = list(i)
            for e in range(edits):
                t[(2 * e + 1) * len(t) // (2 * edits)] = word()
            texts.append([word() for _ in range(rnd.randint(0, 9))] + t + [word() for _ in range(7)])
            texts.append(i[len(i) // 11 :])
    laid = decontaminate.word_hashes([" ".join(t) for t in texts])
    of = lambda h: {(d, i) for d, i, *_ in h.search(*laid)}
    make = lambda: decontaminate.Items(list(range(len(items))), [" ".join(i) for i in items], 0.8)
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if 2 * len(set(t) & set(item)) > len(set(item)) and brute_leak(t, item)[0] >= 0.8}
    assert len(want) > 60 and of(make()) == want
    long, short, no = make(), make(), make()
    long.parts, no.parts, no.classes = [], [], []
    short.classes = []
    assert of(long) < want and of(short) <= want and not of(no)


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    c = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = {}
    for k, t in enumerate(raw):
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, cover, strict=True) if not x)
        s = bytes(cover)
        out[k] = (len(t), sum(cover), s.count(b"\0\1") + (s[:1] == b"\1"), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_against_brute_force(spark):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abé \n") for _ in range(400))
    texts = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 90))) + base[(a := rnd.randint(0, 350)) : a + rnd.randint(0, 120)] + "ab" * rnd.randint(0, 60) for _ in range(40)]
    texts += [texts[0], base, "", None, "z" * 300]
    got = substring_dedup.removed(docs_of(spark, texts), 50).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_removed(texts, 50)


def test_long_substrings_and_shared_passages(spark):
    rnd = random.Random(17)
    text = lambda n: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    passage, common_one, long_one = text(51), text(52), text(120)
    texts = [text(150) for _ in range(20)]
    texts += [f"{text(60)} {passage} {text(60)}" for _ in range(2)] + [f"{text(30)} {common_one} {text(30)}" for _ in range(40)] + [f"{text(30)} {long_one[k:]} {text(30)}" for k in range(3)]
    assert 237 <= min(len(passage), len(common_one)) and max(len(passage), len(common_one)) < 400 < len(long_one)
    got = {r["doc_id"]: r for r in substring_dedup.removed(docs_of(spark, texts), large=10).collect()}
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == brute_removed(texts, 400)
    assert [k for k, r in sorted(got.items()) if r["n_shared"]] == list(range(20, 65))


def test_induced_sorting():
    rng = np.random.default_rng(4)
    for _ in range(60):
        s = np.append(np.repeat(rng.integers(1, 4, rng.integers(1, 40)), rng.integers(1, 4)), 0)
        assert substring_dedup.suffix_array(s, 5, 10**6).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_pieces_equal_the_public_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    texts = [t for t in ODD if t is not None] + ["  two  spaces ", "The quick brown fox, 3.14!\n", "日本語" * 40, " " * 90]
    got = {r["doc_id"]: r for r in sentence_pieces.encode(docs_of(spark, [*texts, None]), sentence_pieces.Pieces(sentence_pieces.MODEL)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == sp.encode(t) and got[i]["round_trip"]
    assert got[len(texts)]["ids"] is None


def test_token_counts(spark, tmp_path):
    docs = [[1, 2, 3], [], [4], [5] * 50, [], [6, 7]]
    flat = b"".join(np.array(d + [0], "<u2").tobytes() for d in docs) + np.array([9, 9], "<u2").tobytes()
    (tmp_path / "a.bin").write_bytes(flat)
    (tmp_path / "b.bin").write_bytes(np.array([0], "<u2").tobytes())
    for size in (4, 16, 1000):
        s = token_counts.stitch(token_counts.scan(token_counts.flat_blocks(spark, str(tmp_path), size), 0), group=3)
        got = {}
        for r in token_counts.lengths(s).orderBy("file", "ordinal").collect():
            got.setdefault(r["file"], []).append(r["n_tokens"])
        assert sorted(got.values()) == sorted([[3, 0, 1, 50, 0, 2, 2], [0]])


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_token_counts_of_documents(spark, odd, none, block_bytes):
    import base64

    import tiktoken

    with open(token_counts.RANKS, "rb") as f:
        ranks = f.read()
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoder = tiktoken.Encoding("flat", pat_str=token_counts.PATTERN, mergeable_ranks=known, special_tokens={})
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.counts(odd.repartition(3), ranks, block_bytes).collect())
    assert got == Counter((r["doc_id"], len(encoder.encode(r["text"] or "", disallowed_special=()))) for r in odd.collect())
    assert token_counts.counts(none, ranks).count() == 0


def test_language(spark):
    en, fr = "the and of that with this from was ", "les des une dans pour avec est que "
    d = spark.createDataFrame([(i, (en if i % 2 else fr) * 20, "en" if i % 2 else "fr") for i in range(30)], "doc_id long, text string, lang string")
    m = language_id.train(d)
    got = {r["doc_id"]: r for r in language_id.identify(docs_of(spark, [en, fr, None, "123 !", en * 400]), m).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["en", "fr", "und", "und", "en"] and got[2]["score"] == 0
    # stated languages: right, of a text without letters, none, and wrong
    asked = docs_of(spark, [en, None, "12", fr, fr * 30, en * 30]).withColumn("lang", F.expr("case doc_id when 0 then 'en' when 2 then 'en' when 4 then 'en' when 5 then 'xx' end"))
    assert [(r["doc_id"], r["lang"]) for r in language_id.keep_identified(asked, m).orderBy("doc_id").collect()] == [(0, "en"), (3, "fr"), (4, "fr"), (5, "en")]
    assert [(r["doc_id"], r["lang"]) for r in language_id.keep_identified(asked, language_id.train(d.where("false"))).orderBy("doc_id").collect()] == [(0, "en"), (3, None), (4, "en"), (5, "xx")]


def naive_phrases(known, text, block):
    """Longest matches of ``text`` in ``known`` from left to right, block by block; a letter that is not there is a phrase."""
    n = 0
    for lo in range(0, len(text), block):
        part, at = text[lo : lo + block], 0
        while at < len(part):
            length = 1
            while at + length < len(part) and part[at : at + length + 1] in known:
                length += 1
            n, at = n + 1, at + length
    return n


def test_phrases_against_longest_matches():
    rnd = random.Random(21)
    letters = {"a": "abcde", "b": "cdefg", "c": "αβγab"}
    text = lambda alphabet, n: "".join(rnd.choice(alphabet + " ") for _ in range(n)).strip() or "a"
    taught = {lang: [text(x, 150)] for lang, x in letters.items()}
    model = language_id.Model(taught, 10_000)
    texts = [text(rnd.choice(["abcde", "abcdefgαβγ", "xyzab", "xyz", "ж"]), rnd.randint(1, 60)) for _ in range(150)]
    learned = {lang: "".join(map(chr, language_id.normalise(t).tolist())) + " " for lang, (t,) in taught.items()}
    norm = [language_id.normalise(t) for t in texts]
    for block in (7, 2048):
        got = model.phrases(norm, block)
        for row, lang in enumerate(model.langs):
            assert got[row].tolist() == [naive_phrases(learned[lang], "".join(map(chr, t.tolist())), block) for t in norm]


def test_automaton_knows_all_substrings():
    rng = np.random.default_rng(6)
    c = rng.integers(1, 4, 60)
    nxt = language_id.automaton(c)
    for i in range(60):
        for j in range(i + 1, min(60, i + 8)):
            s = 0
            for x in c[i:j].tolist():
                s = nxt[s][x]


def test_languages_of_large_scripts():
    rnd = random.Random(13)
    words = {lang: ["".join(chr(0x4E00 + rnd.randrange(1500)) for _ in range(3)) for _ in range(200)] for lang in ("a", "b", "c")}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    latin = "".join(map(chr, [*range(97, 123), *range(0x3B1, 0x3C9), *range(0x430, 0x450)])) + " "
    m = language_id.Model({**{lang: [text(lang, 1500)] for lang in words}, "latin": [latin * 200]}, 30_000)
    got = m.phrases([language_id.normalise(text(lang, 100)) for lang in ("a", "b", "c")] + [language_id.normalise(latin)], 2048)
    assert got.argmin(0).tolist() == [0, 1, 2, 3]
    assert all(2 * got[i, i] < np.delete(got[:, i], i).min() for i in range(3))


def test_toxicity_sees_gaps():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeiourstnlhd") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    texts, y = [], []
    for i in range(500):
        bag = [rnd.choice(words) for _ in range(40)]
        if i % 4 == 0:
            bag.insert(5, rnd.choice(["blockhead", "nitwit", "scumbag"]))
        texts.append(" ".join(bag))
        y.append(int(i % 4 == 0))
    m = toxicity.fit(texts, y)
    p = lambda t: m.probability(np.array([max(toxicity.score_words(sorted(toxicity.words_of(t)), m.weight, m.bias), default=m.empty)]))[0]
    assert p("you nitwit") > 0.3 and p("you nitt-wit") > 0.3 and p("b l o c k h e a d") > 0.3
    assert p(" ".join(words[:30])) < 0.3 and p("") < 0.3


def test_quality(spark):
    rnd = random.Random(9)
    good = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    rows = [(i, good() if i % 2 else "BUY!! " * 30, "en", "a" if i % 2 else "b", 100) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = d.where("doc_id < 120").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.score(d, quality.train(d, lab)).collect()
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got)


def test_co_training_helps_or_is_left_out():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 48)
    pool_y = rng.integers(0, 2, 2000)
    strong = lambda t: (t[:, None] * 2.0 - 1 + rng.normal(0, 0.5, (len(t), 4))).astype(np.float32)
    weak = lambda t: np.hstack([t[:, None] * 1.2 - 0.6 + rng.normal(0, 1, (len(t), 1)), rng.normal(0, 1, (len(t), 40))]).astype(np.float32)
    noise = lambda t: rng.normal(0, 1, (len(t), 12)).astype(np.float32)
    right = lambda p, t: float(((p >= 0.5) == (t == 1)).mean())

    def pick(pool):
        def surest(weights, bounds):
            out = []
            for v in (0, 1):
                value = pool[v] @ weights[v][:-1] + weights[v][-1]
                rows = np.r_[np.flatnonzero(value <= bounds[v][0])[:150], np.flatnonzero(value >= bounds[v][1])[:150]]
                out.append(([x[rows] for x in pool], (value[rows] > 0).astype(float)))
            return out

        return surest

    for second in (weak, noise):
        xs, pool = [strong(y), second(y)], [strong(pool_y), second(pool_y)]
        alone, taught = quality.fit(xs, y, pick(pool), rounds=0), quality.fit(xs, y, pick(pool))
        a, b = alone.scores(pool), taught.scores(pool)
        assert right(b[2], pool_y) >= max(right(b[0], pool_y), right(b[1], pool_y)) - 0.005
        assert right(b[0], pool_y) >= right(a[0], pool_y) - 0.005
        if second is weak:
            assert right(b[1], pool_y) > right(a[1], pool_y) + 0.02
        else:
            flat = quality.Learner(xs[1], y, np.arange(len(y)) % 4).trusted(0.8)
            assert not np.isfinite(flat).any()


def test_odd_inputs(spark, odd, none):
    bench = spark.createDataFrame([(1, "same words here for all")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    lang = language_id.train(odd)
    runs = {
        "secrets": lambda d: secret_scan.scan(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
        "language": lambda d: language_id.identify(d, lang),
        "pieces": lambda d: sentence_pieces.encode(d, sentence_pieces.Pieces(sentence_pieces.MODEL)),
        "join": lambda d: ngram_join.join(d),
        "substrings": lambda d: substring_dedup.removed(d),
    }
    for name, f in runs.items():
        assert f(odd).count() == 13, name
        assert f(none).count() == 0, name
    assert decontaminate.leaks(odd, bench).count() == 3 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.where("false")) is not None
    assert language_id.train(none).langs == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    words = lambda seed, n: " ".join("".join(random.Random(f"{seed}{i}").choice("abcdefghijklm") for _ in range(6)) for i in range(n))
    leak = words("leak", 30)
    texts = [words("a", 60), words("a", 60), words("b", 60) + " " + leak, words("c", 40) + " password: abcdefghijklmnop", "123", None, words("d", 50)]
    docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    p = sentence_pieces.Pieces(sentence_pieces.MODEL)
    got = {r["doc_id"]: sentence_pieces.decode(r["ids"], p) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {0: texts[0], 3: words("c", 40) + " [SECRET]", 6: texts[6]}
