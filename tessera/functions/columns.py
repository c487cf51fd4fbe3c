"""Transformations of whole columns: scaling, boxes, quantiles, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns centred and divided by their sample standard deviation."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.join(F.broadcast(stats), how="cross")  # one row of statistics
    return out.select(*[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def data_box(coords: DataFrame, dim: int, size: float) -> DataFrame:
    """(id, coords) centred, and scaled so that all coordinates are within half of ``size``."""
    x = [F.col("coords")[j] for j in range(dim)]
    mean = coords.agg(F.array(*[F.avg(c) for c in x]).alias("mean"))
    centred = coords.join(F.broadcast(mean), how="cross").select("id", F.zip_with("coords", "mean", lambda a, m: a - m).alias("coords"))
    most = centred.agg(F.greatest(*[F.max(F.abs(c)) for c in x]).alias("most") if dim > 1 else F.max(F.abs(x[0])).alias("most"))
    return centred.join(F.broadcast(most), how="cross").select("id", F.transform("coords", lambda a: a / (F.col("most") / (size / 2))).alias("coords"))


def quantiles(df: DataFrame, column: str, fractions: list[float], accuracy: int | None = None) -> DataFrame:
    """One row (quantiles array): exact, or approximate at a given accuracy for large tables."""
    q = F.array(*map(F.lit, fractions))
    return df.agg((F.percentile_approx(column, q, accuracy) if accuracy else F.percentile(column, q)).alias("quantiles"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; 0 where it is undefined, as for a single row."""
    r = F.corr(a, b)
    return F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r)
