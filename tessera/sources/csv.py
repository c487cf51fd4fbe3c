"""Delimited vectors: reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = ("#", "%")


def header_size(spark: SparkSession, path: str) -> int:
    """Leading lines that begin with # or %; an error if the file has no other line."""
    n = 0
    for row in spark.read.text(path).toLocalIterator():
        if not row[0].startswith(HEADER):
            return n
        n += 1
    raise ValueError(f"{path} ends inside its header")


def read_vectors_csv(spark: SparkSession, path: str, sep: str = ",", fraction: float = 1.0, seed: int = 4664397, skip_first: bool = False) -> DataFrame:
    """(id, v): one vector a line, numbered from 0 in order; header lines and, with ``skip_first``, the first record left out.

    Errors: fewer than two fields, lines of different widths, fields that are no
    numbers.  With ``fraction`` rows are kept at random, by ``seed``.
    """
    if len(sep) != 1:
        raise ValueError("the delimiter is one character")
    lines = spark.read.text(path).where(~F.col("value").rlike("^[#%]") & (F.length(F.trim("value")) > 0))
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} has no record")
    width = len(first[0].split(sep))
    if width < 2:
        raise ValueError("a record needs two fields at least")
    parts = F.split("value", "\\" + sep if not sep.isalnum() else sep, -1)
    fields = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    checked = F.when(F.size(parts) != width, F.raise_error(F.concat(F.lit("a record of another width: "), "value")).cast("array<double>"))
    checked = checked.when(F.exists(fields, lambda x: x.isNull()), F.raise_error(F.concat(F.lit("not a number in: "), "value")).cast("array<double>")).otherwise(fields)
    numbered = lines.select(F.monotonically_increasing_id().alias("m"), "value")
    if skip_first:
        numbered = numbered.where(F.col("m") > 0)
    if fraction < 1:
        numbered = numbered.where(F.rand(seed) < fraction)
    from ..operators.graph import node_index

    ids = node_index(numbered.select(F.col("m").alias("id"))).withColumnRenamed("id", "m")
    return numbered.select("m", checked.alias("v")).join(ids, "m").select(F.col("idx").alias("id"), "v")


def read_labelled_csv(spark: SparkSession, path: str, n_columns: int, fraction: float = 1.0, seed: int = 4664397) -> DataFrame:
    """(label, v) of a CSV of 29 numbers a line: label 1 where the first is positive, then ``n_columns`` - 1 features.

    Only the columns asked for are parsed.
    """
    names = [f"c{k}" for k in range(29)]
    df = spark.read.csv(path, schema=", ".join(f"{n} double" for n in names), mode="FAILFAST")
    if fraction < 1:
        df = df.sample(fraction, seed)
    return df.select(F.when(F.col("c0") > 0, 1).otherwise(0).alias("label"), F.array(*names[1:n_columns]).alias("v"))


def exponent(x: Column, digits: int = 5, mark: str = "e") -> Column:
    """A number with one digit before the point and the shortest exponent: 1.23450e0."""
    x = x.cast("float").cast("double")
    e0 = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))).cast("int"))
    m0 = x / F.pow(F.lit(10.0), e0)
    over = F.abs(F.round(m0, digits)) >= 10
    under = (F.abs(m0) < 1) & (x != 0)
    e = F.when(over, e0 + 1).when(under, e0 - 1).otherwise(e0)
    return F.concat(F.format_string(f"%.{digits}f", x / F.pow(F.lit(10.0), e)), F.lit(mark), e.cast("string"))


def coords_lines(df: DataFrame, label: str | None = None, sep: str = ",") -> DataFrame:
    """(value): ``label`` and the coordinates of each row as text."""
    cells = F.array_join(F.transform("coords", lambda x: exponent(x)), sep)
    return df.select(F.concat_ws(sep, F.col(label).cast("string"), cells).alias("value") if label else cells.alias("value"))


def write_coords_csv(df: DataFrame, path: str, label: str | None = None, sep: str = ",") -> None:
    """Coordinates in order of id, without header, with five decimals and an exponent."""
    coords_lines(df.orderBy("id") if "id" in df.columns else df, label, sep).write.text(path)
