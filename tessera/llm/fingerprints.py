"""Document fingerprints by SpotSigs: chains of content words after common words.

A common word of a text (an anchor) and the ``CHAIN`` content words that follow
it, whatever common words stand between, are one spot signature.  A text's
fingerprint is the multiset of its signatures (the k-th copy of a signature is
an element of its own), written as sorted 8-digit hex numbers in a row.  Two
fingerprints are compared by the Jaccard coefficient; they fall into partitions
by length, such that only those of equal or neighbouring partitions can be as
alike as asked for, and the others are not compared.

Everything is DataFrame expressions; nothing runs in Python.

Definitions:

* Words are runs of letters, marks and digits, lower-cased, in every script.
* Where no common word has come for ``GAP`` words, and before a text's first
  common word, every word is an anchor, so that lists, other languages and short
  texts have signatures too, and an edit changes signatures near it only.
* A chain ends with the text, so the last chains are shorter.
* A text without words has its whole text as its only signature; null and empty
  texts have none.  Likeness of two empty sets is 1, of an empty and another 0.
* Likeness is 0 where the sets' lengths rule out ``FLOOR``.
* The next document is the next by (doc_id, hash of the text), nulls first;
  after the last comes the first, and a single document follows itself.  Rows
  that repeat both follow each other, and repeated rows are rows each.
* Texts of any length are read whole.  An empty table gives an empty result.
  Further columns, of any name, are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Articles, conjunctions, prepositions and forms of "to be" of six languages.
COMMON = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux ce ces dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "aber auf aus bei das dem den der die ein eine einer es für ich im ist mit nicht sich sie und von war wird zu "
    "al con del el esta la las lo los no para pero por se su sus un una unas y "
    "che da dei della di e gli ha i il lo ma nel non per sono "
    "ao com da do dos e em foi mas na nas no nos o os ou pela são um uma"
).split()

CHAIN = 2
GAP = 8
FLOOR = 0.1
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Most ranges of doc_id that documents are dealt over.
RANGES = 1 << 16


def with_signatures(df: DataFrame, text: str, name: str, anchors: list[str] = COMMON, chain: int = CHAIN, gap: int = GAP) -> DataFrame:
    """``df`` with a column ``name``: the sorted signatures of column ``text``, copies numbered, as 32-bit numbers."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    # a word's hash, and in the last bit whether it is common
    df = df.withColumn("_codes", F.transform(words, lambda w: F.shiftleft(F.xxhash64(w), 1).bitwiseOR(w.isin(*sorted(set(anchors))).cast("long"))))
    df = df.withColumn("_content", F.filter("_codes", lambda c: c.bitwiseAND(F.lit(1)) == 0))
    at = F.filter(F.transform("_codes", lambda c, i: F.when(c.bitwiseAND(F.lit(1)) == 1, i)), lambda i: i.isNotNull())
    df = df.withColumn("_from", F.concat(F.array(F.lit(-gap)), at)).withColumn("_to", F.concat(F.slice("_from", 2, F.size("_codes") + 1), F.array(F.size("_codes"))))

    def spots(p: Column, j: Column) -> Column:
        """Signatures of the common word at ``p``, the j-th, and of the words beyond the gap that follows it."""
        own = F.when(j > 0, F.array(p)).otherwise(F.array().cast("array<int>"))
        end = F.get("_to", j)
        lone = F.when(p + gap < end, F.sequence(p + gap, end - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.concat(own, lone), lambda q: F.xxhash64(F.get("_codes", q), *[F.get("_content", q - j + 1 + c) for c in range(chain)]).bitwiseAND(F.lit(0xFFFFFFFF)))

    df = df.withColumn("_spots", F.sort_array(F.flatten(F.transform("_from", spots)))).withColumn("_once", F.array_distinct("_spots"))
    new = F.transform("_spots", lambda s, i: F.when((i == 0) | (s != F.get("_spots", i - 1)), i))
    df = df.withColumn("_runs", F.when(F.size("_once") < F.size("_spots"), F.concat(F.filter(new, lambda i: i.isNotNull()), F.array(F.size("_spots")))))

    def numbered(s: Column, j: Column) -> Column:
        """The j-th signature, once for each of its copies."""
        copies = F.get("_runs", j + 1) - F.get("_runs", j)
        return F.when(copies == 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), copies), lambda k: F.when(k == 1, s).otherwise(F.xxhash64(s, k).bitwiseAND(F.lit(0xFFFFFFFF)))))

    found = F.when(F.col("_runs").isNull(), F.col("_once")).otherwise(F.array_distinct(F.sort_array(F.flatten(F.transform("_once", numbered)))))
    whole = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.when(F.size("_codes") > 0, found).otherwise(whole)).drop("_codes", "_content", "_from", "_to", "_spots", "_once", "_runs")


def written(signatures: str) -> Column:
    """A set of signatures as a string."""
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def length_part(length: Column, least: float) -> Column:
    """The partition of a set by its length: two sets that are alike by ``least`` are in the same or in neighbouring ones."""
    return F.when(length > 0, F.floor(F.log(length.cast("double")) / -math.log(least) + 1e-9) + 1).otherwise(0)


def likeness(a: str, b: str, least: float = FLOOR) -> Column:
    """Jaccard coefficient of two sets; 0 where the partitions of their lengths rule out ``least``."""
    x, y = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    near = F.abs(length_part(x, least) - length_part(y, least)) <= 1
    return F.when((x == 0) & (y == 0), 1.0).when((x > 0) & (y > 0) & near, both / (x + y - both)).otherwise(0.0)


def with_next(docs: DataFrame, rows: int = 64) -> DataFrame:
    """(doc_id, text, own, next, other): each document's text (null: empty) and signatures, and the next document's.

    Documents are dealt over ranges of (doc_id, hash of text), of about ``rows``
    documents each while there are at most ``RANGES`` of them.  A range begins
    at a document, whose row also goes to the range before, as its last row.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id"), text.alias("text"), F.struct(F.col("doc_id").alias("d"), F.xxhash64(text).alias("h")).alias("key"))
    share = min(1.0, min(RANGES, docs.count() / rows) / max(docs.count(), 1))
    drawn = F.pmod(F.xxhash64("key.d", "key.h", F.lit("range")), F.lit(1 << 30)) < int(share * (1 << 30))
    starts = keyed.agg(F.collect_set(F.when(drawn, F.col("key"))).alias("some"), F.min("key").alias("first"))
    starts = starts.where(F.col("first").isNotNull()).select(F.array_sort(F.array_union("some", F.array("first"))).alias("starts"))
    starts = materialise(starts, "ranges")  # one row of at most about RANGES keys
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(RANGES.bit_length() + 1))])
    at = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get("starts", n + s - 1) <= F.col("key"), n + s).otherwise(n))
    dealt = keyed.join(F.broadcast(starts), how="cross").withColumn("part", at)
    guest = F.when(F.col("part") > 1, F.col("part") - 1).otherwise(F.size("starts"))
    places = F.when(F.get("starts", F.col("part") - 1) == F.col("key"), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(guest.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))))
    dealt = dealt.select("doc_id", "text", "key", F.inline(places))
    dealt = with_signatures(dealt.repartition("part"), "text", "own")  # texts are shuffled, not signatures
    order = Window.partitionBy("part").orderBy("guest", "key")
    return dealt.withColumn("next", F.lead("text").over(order)).withColumn("other", F.lead("own").over(order)).where(~F.col("guest")).select("doc_id", "text", "own", "next", "other")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_signatures) of every document."""
    s = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sigs")
    return s.select("doc_id", written("sigs").alias("fingerprint"), F.size("sigs").alias("n_signatures"))


def near_pairs(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of ``sets`` (id, sigs) that are alike by ``least`` or more, a < b.

    Equal sets are one class, named by its smallest id, and pairs are between
    classes.  A set meets others only over its rarest signatures (as many as one
    that it must share at ``least``) and only within its own and the next
    partition of lengths; what meets is compared.  Empty sets are left out.
    """
    sets = sets.where(F.size("sigs") > 0)
    classes = materialise(sets.groupBy("sigs").agg(F.min("id").alias("id")), "classes")
    often = classes.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    size = F.size("sigs")
    rows = classes.select("id", size.alias("l"), F.explode("sigs").alias("s")).join(often, "s")
    order = Window.partitionBy("id").orderBy("n", "s")
    keys = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("l") - F.ceil(F.col("l") * least - 1e-9) + 1).select("id", "l", "s", length_part(F.col("l"), least).alias("p"))
    probe = keys.select("id", "l", "s", F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("p"), F.col("p").alias("own"))
    a, b = probe.alias("a"), keys.alias("b")
    within = (F.least("a.l", "b.l") >= F.greatest("a.l", "b.l") * least - 1e-9) & ((F.col("a.own") < F.col("b.p")) | (F.col("a.id") < F.col("b.id")))
    met = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.p") == F.col("b.p")) & within & (F.col("a.id") != F.col("b.id")))
    met = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    left, right = classes.select(F.col("id").alias("a"), F.col("sigs").alias("x")), classes.select(F.col("id").alias("b"), F.col("sigs").alias("y"))
    return met.join(left, "a").join(right, "b").select("a", "b", likeness("x", "y", least).alias("likeness")).where(F.col("likeness") >= least - 1e-9)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - quarter)
    docs = docs.withColumn("edited", F.concat(kept, F.substring(F.col("next"), F.lit(1), quarter))).drop("next")
    docs = with_signatures(docs, "edited", "changed")
    return docs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("own").alias("fingerprint"),
        written("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "other").alias("near_next"),
        F.size("own").alias("n_signatures"),
    )
