"""Aligned tokens against brute force, and on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import alignment

SCHEMA = "doc_id long, text string, ref string, k string, pairs string"
ODD = [None, "", " ", "   \n\t", "a", "Zoë Åß 日本語 \U0001f600", "same words here", "same words here", "▁ is not a space", "a\0b\x01", "İSTANBUL ﬁ", "<|endoftext|> <s> </s> <unk>", "\r\n\r\n  x", "x" * 3000, " " * 6000 + "end", "日本語" * 400]


def brute(rows):
    """The contract by loops over the public libraries' ids; the texts' digests and the pairs' counts."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(alignment.A_FILE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    letters = alignment.Sides._byte_letters()
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, held = [], Counter()
    for i, t in rows:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        raw_a, raw_b = [bytes(letters[c] for c in tok.id_to_token(x)) for x in a], [b_bytes(x) for x in b]
        if not t or {b"".join(raw_a), b"".join(raw_b)} != {b" " + t.encode()}:
            docs.append((i, [], [], [], Counter()))
            continue
        ends = lambda raw: np.cumsum([len(x) for x in raw]).tolist()
        ea, eb = ends(raw_a), ends(raw_b)
        groups = []
        start = 0
        for cut in sorted(set(ea) & set(eb)):
            groups.append(([x for x, e in zip(a, ea, strict=True) if start < e <= cut], [x for x, e in zip(b, eb, strict=True) if start < e <= cut]))
            start = cut
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        docs.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        best = sum(m for (x, y), m in links.items() if held[x, y] == most[x])
        out.append((i, len(a), len(b), len(groups), sum(links.values()), best, sum(m * held[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return Counter(out), held


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("rows", [1_000_000, 60])
def test_alignment_against_brute_force(spark, rows):
    rnd = random.Random(1)
    words = ["the", "cat's", "Zoë", "hyperparameter", "12,345.67", "naïve", "日本", "\n", "  ", "tokenisation", "...", "\U0001f600", "of"]
    texts = [rnd.choice(["", " "]).join(rnd.choice(words) + " " * rnd.randint(0, 1) for _ in range(rnd.randint(1, 40))) for _ in range(80)] + ODD
    data = [*enumerate(texts), (6, texts[6]), (6, texts[6]), (None, "no id"), (None, "no id")]
    d = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in data], SCHEMA).repartition(3)
    got, counts = alignment.align(d, rows=rows)
    want, held = brute(data)
    assert rows_of(got) == want
    assert {(r["a"], r["b"]): r["documents"] for r in counts.collect()} == held


def test_empty_table(spark):
    d = spark.createDataFrame([(1, "x", "", "", "")], SCHEMA)
    got, counts = alignment.align(d.where("false"))
    assert got.count() == 0 and counts.count() == 0
    got, counts = alignment.align(d.withColumn("text", d.text.substr(5, 1)))
    assert rows_of(got) == Counter([(1, 0, 0, 0, 0, 0, 0, "")]) and counts.count() == 0


def test_long_groups_are_linked_by_distinct_ids():
    rng = np.random.default_rng(3)
    na, nb = rng.integers(1, 40, 6), rng.integers(1, 40, 6)
    ia, ib = rng.integers(0, 5, na.sum()), rng.integers(0, 7, nb.sum())
    ga, gb, doc = np.repeat(np.arange(6), na), np.repeat(np.arange(6), nb), np.array([0, 0, 1, 1, 1, 2])
    want = Counter((int(doc[g]), int(x), int(y)) for g in range(6) for x in ia[ga == g] for y in ib[gb == g])
    for large in (0, 100, 1 << 20):
        d, a, b, m = alignment._linked(ia, ib, ga, gb, na, nb, doc, large)
        got = list(zip(d.tolist(), a.tolist(), b.tolist(), strict=True))
        assert dict(zip(got, m.tolist(), strict=True)) == want and got == sorted(want)
