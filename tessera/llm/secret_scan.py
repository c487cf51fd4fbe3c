"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is analysed (on the driver, while the plan is
made) into a Boolean query of trigrams that every match must contain.  The
index holds a posting ``(trigram, document)`` for each indexed trigram that a
document's lower-cased text contains; a rule's candidates are the intersection
and union of postings that its query asks for; candidates are verified with the
regular expression over the whole text.  Rules without a mandatory trigram scan
every text.

Definitions:

* Matches of a rule are leftmost and do not overlap; those whose measured
  group is too short are dropped afterwards, as are their characters.
* Offsets count code points, the end is exclusive.
* Null text counts as empty.  Every row of the input gives one row; rows that
  repeat give equal rows, an empty table gives none.  Texts of any length are
  searched whole.  Matches of two rules at one place are all reported, in the
  order of the rules.
* Further columns of the input, of any name, are kept in the row.
"""

from __future__ import annotations

import itertools
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_sieve, materialise, row_key, same, sieve, table


@dataclass(frozen=True)
class Rule:
    """kind; regular expression; least length of the measured group (0: all of the match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Public formats of well-known credentials, beside the base rules.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

Query = frozenset  # of frozensets of trigrams: a disjunction of conjunctions
TRUE: Query = frozenset([frozenset()])
WIDEST = 16


def _simplify(q) -> Query:
    return frozenset(c for c in q if not any(d < c for d in q))


def _and(a: Query, b: Query) -> Query:
    return _simplify({x | y for x in a for y in b})


def _needs(strings) -> Query:
    """Trigrams of which one string of the set brings all."""
    return _simplify({frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings})


def _analyse(seq) -> tuple[frozenset | None, Query]:
    """(the strings that it matches, if they are few, else None; what each match contains)."""
    exact, query, whole = frozenset([""]), TRUE, True
    for op, arg in seq:
        part, own = None, TRUE
        if op is rc.LITERAL:
            part = frozenset([chr(arg)])
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 8:
            part = frozenset(chr(c) for _, c in arg)
        elif op is rc.SUBPATTERN:
            part, own = _analyse(arg[3])
        elif op is rc.BRANCH:
            sides = [_analyse(s) for s in arg[1]]
            if all(e is not None for e, _ in sides) and sum(len(e) for e, _ in sides) <= WIDEST:
                part = frozenset(itertools.chain.from_iterable(e for e, _ in sides))
            else:
                own = _simplify(frozenset().union(*(_needs(e) if e is not None else q for e, q in sides)))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, sub = arg
            e, q = _analyse(sub)
            if high == 1 and e is not None:
                part = e | {""} if low == 0 else e
            elif low == high and e is not None and len(e) == 1:
                part = frozenset([next(iter(e)) * int(low)])
            elif low >= 1:
                own = _needs(e) if e is not None else q
        if part is not None and len(joined := frozenset(a + b for a in exact for b in part)) <= WIDEST:
            exact = joined
            continue
        query, whole = _and(query, _needs(exact)), False
        exact = part if part is not None else frozenset([""])
        query = _and(query, own) if part is None else query
    return (exact, TRUE) if whole else (None, _and(query, _needs(exact)))


def trigram_query(rule: Rule) -> Query:
    """The Boolean query of a rule: conjunctions of trigrams, TRUE if none is mandatory."""
    exact, query = _analyse(rp.parse(rule.pattern))
    return _needs(exact) if exact is not None else query


def vocabulary(rules) -> list[str]:
    return sorted({t for r in rules for c in trigram_query(r) for t in c})


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (doc_id, th, trigram): which documents contain which of ``trigrams``, case aside.

    A trigram is its position in the list.  One row for each posting and row of input.
    """
    low = docs.select(*row_key(), F.lower("text").alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("doc_id", "th", F.explode(hits).alias("trigram"))


def candidates(index: DataFrame, rules, trigrams: list[str]) -> DataFrame:
    """(doc_id, th, rules): the rules whose Boolean query a document's postings satisfy, as an array of positions.

    Postings are united to bit sets by document, before and after the shuffle,
    so that no trigram's list is ever held in one place.
    """
    at = {t: i for i, t in enumerate(trigrams)}
    words = -(-len(trigrams) // 60)
    sets = index.groupBy("doc_id", "th").agg(*[F.bit_or(F.when(F.col("trigram").between(60 * w, 60 * w + 59), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") - 60 * w)).otherwise(F.lit(0).cast("long"))).alias(f"s{w}") for w in range(words)])

    def held(conjunction) -> Column:
        test = F.lit(True)
        for w in range(words):
            if mask := sum(1 << (at[t] - 60 * w) for t in conjunction if 60 * w <= at[t] < 60 * w + 60):
                test = test & (F.col(f"s{w}").bitwiseAND(F.lit(mask)) == mask)
        return test

    found = []
    for i, r in enumerate(rules):
        if (q := trigram_query(r)) == TRUE:
            continue
        any_of = F.lit(False)
        for c in sorted(q, key=sorted):
            any_of = any_of | held(c)
        found.append(F.when(any_of, F.lit(i)))
    return sets.select("doc_id", "th", F.array_compact(F.array(*found)).alias("rules")).where(F.size("rules") > 0)


SPANS = "array<struct<start:int,kind:int,stop:int>>"


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of a rule's matches in ``text``: array of (start, kind, stop).

    The text is cut into gaps and matches by one expression that also matches
    at the end of the text, so that the search is linear; offsets are the
    running lengths of the pieces.
    """
    body = f"(?i:{rule.pattern})" if rule.any_case else f"(?:{rule.pattern})"
    cut = F.lit(rf"(?s)(.*?)(?:({body})|\z)")
    pieces = lambda g: F.regexp_extract_all(text, cut, F.lit(g))
    zipped = F.arrays_zip(pieces(1), pieces(2), pieces(2 + rule.group))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPANS).alias("out"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["0"])
        end = begin + F.length(p["1"])
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop")))
        counts = (F.length(p["1"]) > 0) & (F.length(p["2"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(counts, F.concat(F.coalesce(acc["out"], F.array().cast(SPANS)), one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPANS)
    first = {"assign": None, "hex": rf"[0-9a-f]{{{rule.least}}}"}.get(rule.kind)
    found = F.coalesce(F.aggregate(zipped, start, step)["out"], none)
    return F.when(text.rlike(first), found).otherwise(none) if first else found


def scan(docs: DataFrame, rules=BASE + MORE) -> DataFrame:
    """(row, spans) of all rows of ``docs``: its columns as a struct, and the sorted spans of all rules (kind: position in ``rules``).

    Texts of documents with postings meet the rules that their postings allow;
    all other texts are not moved, as only rules without a trigram can match them.
    """
    trigrams = vocabulary(rules)
    found = candidates(trigram_index(docs, trigrams), rules, trigrams)
    found = materialise(found.withColumn("key", F.xxhash64("doc_id", "th")), "candidates")
    packed = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"), *row_key())
    packed = in_sieve(packed.withColumn("key", F.xxhash64("doc_id", "th")), "key", sieve(found, "key"))
    asked = packed.where("_in").alias("d").join(found.alias("c"), same("d", "c", "doc_id", "th", "key"), "left").select("d.row", "d.text", "c.rules")
    none = F.array().cast(SPANS)
    free = [trigram_query(r) == TRUE for r in rules]
    own = [rule_spans(F.col("text"), r, i) for i, r in enumerate(rules)]
    every = [o if f else F.when(F.array_contains("rules", i), o).otherwise(none) for i, (o, f) in enumerate(zip(own, free, strict=True))]
    spans = lambda parts: F.array_sort(F.concat(none, *parts)).alias("spans")
    rest = packed.where("not _in").select("row", spans([o for o, f in zip(own, free, strict=True) if f]))
    return rest.unionByName(asked.select("row", spans(every)))


def span_string(spans: Column, rules) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def redact(docs: DataFrame, rules=BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; n_chars, where there is one, follows the new text.

    Spans that overlap are replaced together.  Texts without a span stay as they are, null included.
    """
    hit = scan(docs, rules)
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("row.text")

    def step(acc, s):
        gap = F.when(s["start"] > acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], gap, F.when(new, F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    whole = F.aggregate("spans", empty, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    hit = hit.select("row", (F.size("spans") > 0).alias("any"), F.when(F.size("spans") > 0, whole).otherwise(text).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("any"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return hit.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE + MORE
    hit = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return hit.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(span_string(base, rules).cast("binary"), 256).alias("base_sha256"),
        span_string(F.col("spans"), rules).alias("spans"),
    )


def _sql_rule(i: int, rule: Rule) -> str:
    body = rule.pattern
    if rule.any_case:  # letters in either case, ASCII alone
        body = re_any_case(body)
    cut = rf"(?s)(.*?)(?:({body})|\z)".replace("'", "''")
    value = 2 + rule.group
    return f"""
  select rn, '{rule.kind}' kind, {i} ord, start, start + length(hit) stop from (
    select rn, unnest(hits) hit, unnest(vals) val,
      unnest(list_transform(range(1, len(gaps) + 1), lambda k: coalesce(list_sum(list_transform(gaps[1:k], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:k-1], lambda g: length(g))), 0)))::bigint start
    from (select rn, regexp_extract_all(text, '{cut}', 1) gaps, regexp_extract_all(text, '{cut}', 2) hits, regexp_extract_all(text, '{cut}', {value}) vals from d))
  where length(hit) > 0 and length(val) >= {rule.least}"""


def re_any_case(pattern: str) -> str:
    """The words of a pattern's first group with a class of both cases for each letter."""
    words, rest = pattern[1:].split(")", 1)
    return "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest


OP1_SQL = (
    "with d as (select row_number() over () rn, doc_id, coalesce(text, '') as text from documents), s as ("
    + " union all ".join(_sql_rule(i, r) for i, r in enumerate(BASE + MORE))
    + """), t as (
  select rn, count(*) filter (ord = 0) n_assign, count(*) filter (ord = 1) n_access, count(*) filter (ord = 2) n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (ord < 3), '') base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) spans
  from s group by rn)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join t using (rn)"""
)
