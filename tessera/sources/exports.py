"""Distances for homology tools, and plot-ready grids."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import distance
from .csv import exponent


def ripser_triplets(edges: DataFrame) -> DataFrame:
    """(i, j, d): each edge in both directions; mutual edges come twice, as the tools that read this expect."""
    a = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("dist").alias("d"))
    return a.unionByName(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def write_ripser_triplets(edges: DataFrame, path: str) -> None:
    t = ripser_triplets(edges)
    t.select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), exponent(F.col("d"), mark="E")).alias("value")).write.text(path)


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, w): triplets with repeated places added up."""
    t = spark.read.csv(path, sep=" ", schema="i long, j long, w double")
    return t.groupBy("i", "j").agg(F.sum("w").alias("w"))


def neighbourhood(points: DataFrame, center: list[float], k: int, metric: str = "l2") -> DataFrame:
    """(r, id, v, d): the k points nearest to ``center``, ranked from 0."""
    c = F.array(*[F.lit(float(x)) for x in center])
    near = points.select("id", "v", distance(metric, F.col("v"), c).alias("d")).orderBy("d", "id").limit(k)
    ranked = near.agg(F.sort_array(F.collect_list(F.struct("d", "id", "v"))).alias("l"))  # k rows
    return ranked.select(F.posexplode("l").alias("r", "x")).select("r", "x.id", "x.v", "x.d")


def local_distance_matrix(points: DataFrame, center: list[float], k: int, metric: str = "l2") -> DataFrame:
    """(r, c, d), c <= r: all distances of a neighbourhood, the diagonal included."""
    n = neighbourhood(points, center, k, metric)
    a, b = n.select("r", F.col("v").alias("x")), n.select(F.col("r").alias("c"), F.col("v").alias("y"))
    return a.join(b, F.col("r") >= F.col("c")).select("r", "c", distance(metric, F.col("x"), F.col("y")).alias("d"))


def bson_array(name: str, values: list[float]) -> bytes:
    """A BSON document with one array of doubles."""
    body = b"".join(b"\x01" + str(i).encode() + b"\x00" + struct.pack("<d", v) for i, v in enumerate(values))
    array = struct.pack("<i", len(body) + 5) + body + b"\x00"
    doc = b"\x04" + name.encode() + b"\x00" + array
    return struct.pack("<i", len(doc) + 5) + doc + b"\x00"


def parse_bson_array(data: bytes) -> tuple[str, list[float]]:
    end = data.index(b"\x00", 5)
    name, at = data[5:end].decode(), end + 5
    out = []
    while data[at] == 1:
        at = data.index(b"\x00", at + 1) + 1
        out.append(struct.unpack("<d", data[at : at + 8])[0])
        at += 8
    return name, out


def write_local_bson(matrix: DataFrame, path: str) -> None:
    """The lower triangle (r, c, d), row by row, as BSON {limat: [...]} (a neighbourhood's size)."""
    values = [r["d"] for r in matrix.orderBy("r", "c").collect()]
    with open(path, "wb") as f:
        f.write(bson_array("limat", values))


def lower_to_full(values: DataFrame) -> DataFrame:
    """(r, c, d) of the symmetric matrix of a lower triangle (pos from 0, d)."""
    r = F.floor((F.sqrt(8.0 * F.col("pos") + 1) - 1) / 2).cast("long")
    t = values.select(r.alias("r"), (F.col("pos") - r * (r + 1) / 2).cast("long").alias("c"), "d")
    return t.unionByName(t.where("r <> c").select(F.col("c").alias("r"), F.col("r").alias("c"), "d"))


def label_plot(df: DataFrame, sigma: float | None = None) -> DataFrame:
    """(label, color, x, y) and further columns: labels numbered from 1 in order; coordinates held within ``sigma`` deviations of the mean."""
    from pyspark.sql import Window

    colors = df.select("label").distinct().withColumn("color", F.row_number().over(Window.orderBy("label")))
    out = df.join(F.broadcast(colors), "label")  # as many rows as labels
    first = [*[c for c in df.columns if c not in ("label", "x", "y")], "label", "color"]
    if sigma is None:
        return out.select(*first, "x", "y")
    s = df.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    held = lambda c: F.greatest(F.least(F.col(c), F.col(f"m{c}") + sigma * F.col(f"s{c}")), F.col(f"m{c}") - sigma * F.col(f"s{c}"))
    return out.join(F.broadcast(s), how="cross").select(*first, held("x").alias("x"), held("y").alias("y"))


def _cells(df: DataFrame, n: int) -> DataFrame:
    box = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda c: F.floor((n - 1) * (F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0"))).cast("int")
    return df.join(F.broadcast(box), how="cross").withColumn("gx", cell("x")).withColumn("gy", cell("y"))


def distance_grid(df: DataFrame, n: int = 1001) -> DataFrame:
    """(gx, gy, value) of the cells with points: exp(-(mean - least) / (2 deviation)), the deviation over all n * n cells."""
    cells = _cells(df, n).groupBy("gx", "gy").agg(F.avg("value").alias("m"))
    total = float(n * n)
    s = cells.agg(F.min(F.when(F.col("m") > 0, F.col("m"))).alias("least"), F.sqrt((F.sum(F.col("m") * F.col("m")) - F.sum("m") * F.sum("m") / total) / (total - 1)).alias("dev"))
    return cells.join(F.broadcast(s), how="cross").select("gx", "gy", F.when(F.col("m") > 0, F.exp(-(F.col("m") - F.col("least")) / (2 * F.col("dev")))).otherwise(0.0).alias("value"))


def continuity_grid(df: DataFrame, n: int = 1001) -> DataFrame:
    """(gx, gy, value): least of 2 and the logarithm of the last row's value (1 at least) in each cell; empty cells count as -2."""
    last = _cells(df, n).groupBy("gx", "gy").agg(F.max_by("value", "id").alias("v"))
    return last.select("gx", "gy", F.least(F.log(F.greatest("v", F.lit(1.0))), F.lit(2.0)).alias("value"))
