"""Command line: python -m tessera.cli embed|dmap --csv FILE --out FOLDER ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.vectors import METRICS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("embed", "dmap"):
        c = sub.add_parser(name)
        c.add_argument("--csv", required=True)
        c.add_argument("--out", default="embedded.csv" if name == "embed" else "dmap_embedded.csv")
        c.add_argument("--delim", default=",")
        c.add_argument("--dim", type=int, default=2)
        c.add_argument("--layer", type=int, default=0)
        c.add_argument("--quality", type=float, help="fraction of rows to load; embed also reports its quality")
        c.add_argument("--dist", choices=METRICS, default="DistL2")
        c.add_argument("--nbconn", type=int, default=64)
        c.add_argument("--ef", type=int, default=512)
        c.add_argument("--knbn", type=int, default=10)
        c.add_argument("--scale_modify_f", type=float, default=1.0)
        c.add_argument("--method", choices=("tiles", "sql", "approx", "descent"), default="tiles")
        if name == "embed":
            c.add_argument("--batch", type=int, default=20)
            c.add_argument("--nbsample", type=int, default=10)
            c.add_argument("--scale", type=float, default=1.0)
            c.add_argument("--stepg", type=float, default=2.0)
        else:
            c.add_argument("--alfa", type=float, default=1.0)
            c.add_argument("--beta", type=float, default=0.0)
            c.add_argument("--time", type=float, default=5.0)
            c.add_argument("--epsil", type=float, default=2.0)
            c.add_argument("--gnbn", type=int, default=12)
    return p


def main(argv: list[str] | None = None) -> int:
    from . import api
    from .operators.knn import knn

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    common = {"outfile": a.out, "delim": a.delim, "dim": a.dim, "hierarchy": a.layer, "distance": a.dist, "nbconn": a.nbconn, "ef": a.ef, "knbn": a.knbn, "scale_modify_f": a.scale_modify_f, "method": a.method}
    points = api.read_vectors_csv(spark, a.csv, a.delim, a.quality or 1.0).persist()
    if a.command == "embed":
        out = api.embed(points, batch=a.batch, nbsample=a.nbsample, scale=a.scale, grad_step=a.stepg, **common)
        if a.quality:
            n = points.count()
            api.quality(knn(points, a.knbn, a.dist), out, min(100, n - 1)).show(truncate=False)
    else:
        api.dmap_embed(points, alfa=a.alfa, beta=a.beta, time=a.time, epsil=a.epsil, gnbn=a.gnbn, **common)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
