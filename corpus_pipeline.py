"""A corpus pipeline: language, near copies, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept, and is
written as Parquet and read again before the next.

* language_id drops documents whose language cannot be told (no letters) and
  writes the identified language into lang.
* ngram_join keeps one document of each group of near copies (five words, 0.8).
* decontaminate drops documents that contain a benchmark item.
* secret_scan replaces secrets in the texts.
* sentence_pieces returns doc_id and the ids of each text.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, ngram_join, secret_scan, sentence_pieces
from tessera.llm.common import bucket, materialise, table


def bounded(stage):
    """The stage with Python workers fed by bytes, not by numbers of rows, so that long texts do not add up to large batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(bucket("doc_id", 3) != 1))
    return language_id.keep_identified(docs, model)


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


@bounded
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@bounded
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


@bounded
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(docs, sentence_pieces.Pieces(sentence_pieces.MODEL))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secret_scan", redact_secrets),
    ("sentence_pieces", encode_pieces),
]

#: Language, benchmark similarity and token ids cannot be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
