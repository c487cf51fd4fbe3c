"""Token counts of documents in flat token files, by a separator scan.

A flat token file is a run of unsigned 16-bit (or 32-bit) little-endian ids in
which an end-of-document id follows each document; there is no index.  A file is
a sequence of blocks of any size in bytes (an id may straddle two of them).  A
block is searched for separators with one vectorised comparison; it gives the
lengths of the documents that begin and end in it, and the open pieces at its
two ends.  Running sums over the block summaries (one row a block) number the
documents and stitch the pieces: first within groups of blocks, then over the
groups, so that no task holds more than a group.

Definitions:

* Documents are numbered from 0 in each file.  Ids after the last separator are
  a document of their own unless there are none.
* An empty document (two separators in a row) counts 0 tokens.
* A file whose size is no multiple of the id's width raises an error.
* A null text is an empty document.  Rows with a null doc_id and repeated rows
  are counted like any other; an empty table gives no rows.  A text of any
  length is cut over blocks.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern of this public byte-level vocabulary, and its end-of-text id.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END = 50256

BLOCKS = "file long, block long, data binary, docs array<long>"
SUMMARY = "file long, block long, n_seps long, head long, tail long, inner binary, docs array<long>"


def scan_block(data: bytes, end: int, dtype: str = "<u2") -> tuple[int, int, int, np.ndarray]:
    """(separators, ids before the first, ids after the last, lengths between neighbours) of a block."""
    ids = np.frombuffer(data, dtype)
    at = np.flatnonzero(ids == end)
    if not len(at):
        return 0, len(ids), 0, np.zeros(0, np.int64)
    return len(at), int(at[0]), len(ids) - int(at[-1]) - 1, np.diff(at) - 1


def scan(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """One summary row for each block (file, block, data, docs): see SUMMARY."""

    def run(batches):
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("n_seps", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.binary()), ("docs", pa.list_(pa.int64()))])
        for b in batches:
            for file, block, data, docs in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                n, head, tail, inner = scan_block(data or b"", end, dtype)
                yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "n_seps": [n], "head": [head], "tail": [tail], "inner": [inner.astype(np.int64).tobytes()], "docs": [docs]}, schema)

    return blocks.mapInArrow(run, SUMMARY)


def stitch(summary: DataFrame, group: int = 512) -> DataFrame:
    """(file, block, n_seps, first, lead, head, tail, inner, docs) with, for each block, the number of its first document and the ids
    that lie between the last separator before the block and its begin.

    A prefix scan in two levels: groups of ``group`` blocks, then the groups of a file.
    """
    g = F.floor(F.col("block") / group)
    s = summary.withColumn("grp", g).withColumn("whole", F.when(F.col("n_seps") == 0, F.col("head")).otherwise(F.col("tail")))
    # the state after some blocks: separators so far, ids since the last one; joining two states is associative
    in_group = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    resets = F.sum(F.when(F.col("n_seps") > 0, 1).otherwise(0)).over(Window.partitionBy("file", "grp").orderBy("block"))
    s = s.withColumn("seps_before", F.coalesce(F.sum("n_seps").over(in_group), F.lit(0))).withColumn("run", resets)
    s = s.withColumn("run_before", F.when(F.col("n_seps") > 0, F.col("run") - 1).otherwise(F.col("run")))
    runs = s.groupBy("file", "grp", "run").agg(F.max(F.struct("block", "whole")).alias("_last"), F.sum("whole").alias("total"))
    upto = Window.partitionBy("file", "grp", "run").orderBy("block")
    s = s.withColumn("since", F.sum("whole").over(upto))  # ids since the run's separator, this block included
    before = F.lag("since", 1, 0).over(Window.partitionBy("file", "grp").orderBy("block"))
    s = s.withColumn("open", F.coalesce(before, F.lit(0)))
    totals = runs.groupBy("file", "grp").agg(F.max(F.struct("run", "total")).alias("end"))
    counts = s.groupBy("file", "grp").agg(F.sum("n_seps").alias("seps"))
    groups = totals.join(counts, ["file", "grp"])
    order = Window.partitionBy("file").orderBy("grp")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("first", F.coalesce(F.sum("seps").over(past), F.lit(0)))
    groups = groups.withColumn("era", F.coalesce(F.sum(F.when(F.col("seps") > 0, 1).otherwise(0)).over(past), F.lit(0)))
    groups = groups.withColumn("carry_out", F.col("end.total")).withColumn("own_era", F.col("era") + F.when(F.col("seps") > 0, 1).otherwise(0))
    summed = F.sum("carry_out").over(Window.partitionBy("file", "own_era").orderBy("grp"))
    groups = groups.withColumn("state", summed)
    groups = groups.withColumn("lead", F.coalesce(F.lag("state", 1, 0).over(order), F.lit(0))).select("file", "grp", "first", "lead")
    out = s.join(groups, ["file", "grp"])
    lead = F.col("open") + F.when(F.col("seps_before") == 0, F.col("lead")).otherwise(0)
    return out.select("file", "block", "n_seps", (F.col("first") + F.col("seps_before")).alias("first"), lead.alias("lead"), "head", "tail", "inner", "docs")


def lengths(stitched: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of every document that a separator ends, and of the last piece of a file if it has ids."""
    last = F.max("block").over(Window.partitionBy("file"))
    s = stitched.withColumn("is_last", F.col("block") == last)

    def run(batches):
        for b in batches:
            for file, n, first, lead, head, tail, inner, is_last in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                got = [] if n == 0 else [np.r_[lead + head, np.frombuffer(inner, np.int64)]]
                rest = lead + head if n == 0 else tail
                if is_last and rest:
                    got.append(np.array([rest], np.int64))
                if got:
                    counts = np.concatenate(got)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), file, np.int64)), pa.array(first + np.arange(len(counts))), pa.array(counts.astype(np.int64))], ["file", "ordinal", "n_tokens"])

    return s.select("file", "n_seps", "first", "lead", "head", "tail", "inner", "is_last").mapInArrow(run, "file long, ordinal long, n_tokens long")


def flat_blocks(spark: SparkSession, path: str, block_bytes: int = 4 << 20) -> DataFrame:
    """Blocks (file, block, data, docs) of the flat token files under ``path``, in any store that Spark reads.

    ``file`` is a hash of the path.  A file is read whole by one task: keep files under some hundred MB.
    """

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in range(0, max(len(data), 1), block_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k // block_bytes]), pa.array([data[k : k + block_bytes]], pa.binary()), pa.array([None], pa.list_(pa.int64()))], ["file", "block", "data", "docs"])

    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path"), "content").mapInArrow(run, BLOCKS)


def token_stream(docs: DataFrame, ranks: bytes, block_bytes: int = 1 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """The flat token stream of each partition of ``docs`` as blocks, with the ids of the documents that begin in each.

    A partition is a file.  Text is encoded as ordinary text with the given byte-level vocabulary; null counts as empty.
    """

    def run(batches):
        import tiktoken
        from pyspark import TaskContext

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encoder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        file, block = TaskContext.get().partitionId(), 0
        held, size, begun = [], 0, []

        def flush():
            nonlocal held, size, begun, block
            out = pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([begun], pa.list_(pa.int64()))], ["file", "block", "data", "docs"])
            held, size, begun, block = [], 0, [], block + 1
            return out

        stop = np.array([END], "<u2").tobytes()
        for b in arrow_batches(batches, batch_bytes):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                begun.append(doc)
                data = encoder.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes() if text else b""
                data += stop
                for k in range(0, len(data), block_bytes):
                    piece = data[k : k + block_bytes]
                    held.append(piece)
                    size += len(piece)
                    if size >= block_bytes:
                        yield flush()
        if held or begun:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def named(stitched: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id): the documents that begin in each block, in order."""

    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = stitched.where(F.col("docs").isNotNull()).withColumn("n", F.size("docs").cast("long"))
    s = s.withColumn("begin", F.coalesce(F.sum("n").over(order), F.lit(0)))

    def run(batches):
        for b in batches:
            for file, begin, docs in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), file, np.int64)), pa.array(begin + np.arange(len(docs))), pa.array(docs, pa.int64())], ["file", "ordinal", "doc_id"])

    return s.select("file", "begin", "docs").mapInArrow(run, "file long, ordinal long, doc_id long")


def counts(docs: DataFrame, ranks: bytes, block_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs`` (doc_id, text), by way of their flat token stream."""
    stitched = stitch(materialise(scan(token_stream(docs, ranks, block_bytes)), "token-blocks"))
    return lengths(stitched).join(named(stitched), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(RANKS, "rb") as f:
        ranks = f.read()
    return counts(table(spark, sf_dir, "documents"), ranks)
