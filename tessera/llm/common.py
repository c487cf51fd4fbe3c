"""What the corpus operators share: tables, row keys, shared intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one is made only where none is configured and the master is local."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with files that survive lost executors.  The files are
    removed when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = where
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for t in tables:
        t._written_to.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(t._written_to, True)


def row_key() -> list[Column]:
    """Key columns of a document row: its id and a hash of its text.

    Rows that agree in both are the same text under the same id, and get the
    same result, so joining back on the key is safe with repeated rows.
    """
    return [F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th")]


def same(a: str, b: str, *cols: str) -> Column:
    """Null-safe equality of the columns of two aliased frames."""
    out = None
    for c in cols:
        e = F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        out = e if out is None else out & e
    return out


#: Bits of a sieve: so it never has more than 8 MB, whatever it is built of.
SIEVE_BITS = 26


def place(key: Column) -> Column:
    """The place of a 64-bit hash in a sieve: its first bits, counted from 1."""
    return F.shiftrightunsigned(key, 64 - SIEVE_BITS) + 1


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(part, bits): which first bits the hashes in ``key`` have, 4 KB a row and at most 2,049 rows.

    A sieve tells most rows that have no partner in ``keys`` before they are
    shuffled.  It lets others pass too, all of them once it is full, so what
    passes must still be joined.
    """
    at = place(F.col(key))
    return keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def sieve_bits(kept: DataFrame) -> np.ndarray:
    """A sieve as one array of bytes, 8 MB, to be shipped to Python functions."""
    out = np.zeros((1 << SIEVE_BITS) // 8, np.uint8)
    for r in kept.collect():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the places of 64-bit hashes are set in an array of ``sieve_bits``."""
    at = (keys.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def in_sieve(df: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """``df`` with a column _in: whether the place of its hash in ``key`` is set in the sieve."""
    at = F.bitmap_bit_position(place(F.col(key)))
    octet = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(octet, (at % 8).cast("int")) == 1, F.lit(False))
    rows = F.broadcast(kept.select(F.col("part").alias("_part"), F.col("bits").alias("_bits")))
    return df.join(rows, F.bitmap_bucket_number(place(F.col(key))) == F.col("_part"), "left").withColumn("_in", found).drop("_part", "_bits")


def join_hot(rows: DataFrame, few: DataFrame, on: str, hot: DataFrame, by: list[str], parts: int = 32) -> DataFrame:
    """Inner join of ``rows`` with ``few`` (one row a value of ``on``), where the values in ``hot`` have very many rows.

    Rows of hot values are dealt over ``parts`` tasks by the hash of their columns ``by``.
    """
    kept = sieve(hot.select(F.xxhash64(on).alias("_key")), "_key")
    left = in_sieve(rows.withColumn("_key", F.xxhash64(on)), "_key", kept)
    left = left.withColumn("_part", F.when(F.col("_in"), F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).otherwise(0)).drop("_key", "_in")
    right = in_sieve(few.withColumn("_key", F.xxhash64(on)), "_key", kept)
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("_in"), parts - 1).otherwise(0)))).drop("_key", "_in")
    return left.join(right, [on, "_part"]).drop("_part")


def bucket(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the labelled rows."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Return freed memory of a Python worker to the system, as workers are kept for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library cannot be asked, memory stays with the worker
        ctypes.CDLL(None).malloc_trim(0)


def arrow_batches(batches, limit: int, column: str = "text"):
    """Split Arrow batches so that ``column`` holds at most about ``limit`` bytes in each piece; memory is given back when they end."""
    yield from _pieces(batches, limit, column)
    give_back()


def _pieces(batches, limit: int, column: str):
    for batch in batches:
        n = batch.num_rows
        size = batch.column(batch.schema.names.index(column)).nbytes
        if n <= 1 or size <= limit:
            yield batch
            continue
        lengths = [0 if v is None else len(v) for v in batch.column(batch.schema.names.index(column)).to_pylist()]
        start = total = 0
        for i, length in enumerate(lengths):
            if i > start and total + length > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += length
        yield batch.slice(start, n - start)
