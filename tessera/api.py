"""What a user calls: embeddings from a table of vectors or a CSV file."""

from __future__ import annotations

from math import floor, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import diffusion, dimension, embedding, hubness, levels, navigate
from .operators import knn as knn_op
from .operators.carre import covariance, distances, gamma, spectra, traces, walk  # noqa: F401
from .operators.graph import degree_summary, node_ranges, radius_at_quantile
from .operators.mst import single_linkage, spanning_forest  # noqa: F401
from .operators.quality import summary as quality  # noqa: F401
from .operators.lineage import keep
from .params import DiffusionParams, EmbedderParams
from .sources.csv import read_vectors_csv, write_coords_csv


def _points(source: DataFrame | str, delim: str, fraction: float | None, spark: SparkSession | None) -> DataFrame:
    if isinstance(source, DataFrame):
        return source if not fraction or fraction >= 1 else source.sample(fraction, 4664397)
    return read_vectors_csv(spark or SparkSession.getActiveSession(), source, delim, fraction or 1.0)


def _graphs(points: DataFrame, k: int, metric: str, layer: int, nbconn: int, scale: float, method: str, ef: int):
    if not layer:
        return keep(knn_op.knn(points, k, metric, method)), None, None
    n = points.count()
    lv = levels.levels(points, nbconn, scale, min(16, floor(log(max(n, 3)))) - 1)
    small = keep(levels.layer_knn(points, lv, layer, k, metric, method=method))
    proj = navigate.project_by_search(points, lv, layer, metric, min(nbconn, 2 * k), ef) if method == "descent" else levels.project(points, lv, layer, metric)
    return small, keep(proj), keep(knn_op.knn(points, k, metric, method))


def embed(source: DataFrame | str, outfile: str | None = None, delim: str = ",", dim: int = 2, batch: int = 20, nbsample: int = 10, hierarchy: int = 0, scale: float = 1.0, quality_sampling: float | None = None, distance: str = "DistL2", nbconn: int = 64, ef: int = 512, knbn: int = 10, scale_modify_f: float = 1.0, grad_step: float = 2.0, method: str = "tiles", spark: SparkSession | None = None, seed: int = 4664397) -> DataFrame:
    """Entropy embedding (id, coords) of (id, v) or of a CSV file; written to ``outfile`` if one is given.

    ``quality_sampling``: fraction of the rows to load.  ``method``: how graphs
    are made; with "descent" points are projected by a search of the upper layers'
    index with lists of ``ef`` points, otherwise exactly, and ``ef`` has no effect.
    """
    points = _points(source, delim, quality_sampling, spark)
    params = EmbedderParams(asked_dim=dim, nb_grad_batch=batch, nb_sampling_by_edge=nbsample, scale_rho=scale, hierarchy_layer=hierarchy, grad_step=grad_step, seed=seed)
    small, proj, large = _graphs(points, knbn, distance, hierarchy, nbconn, scale_modify_f, method, ef)
    out = embedding.embed(small, params) if proj is None else embedding.hierarchical_embed(small, proj, large, params)
    if outfile:
        write_coords_csv(out, outfile)
    return out


def dmap_embed(source: DataFrame | str, outfile: str | None = None, delim: str = ",", dim: int = 2, alfa: float = 1.0, beta: float = 0.0, time: float | None = 5.0, epsil: float = 2.0, gnbn: int | None = 12, hierarchy: int = 0, quality_sampling: float | None = None, distance: str = "DistL2", nbconn: int = 64, ef: int = 512, knbn: int = 10, scale_modify_f: float = 1.0, method: str = "tiles", spark: SparkSession | None = None) -> DataFrame:
    """Diffusion map (id, coords) of (id, v) or of a CSV file; with ``hierarchy`` of the points of the upper layers."""
    points = _points(source, delim, quality_sampling, spark)
    small, _, _ = _graphs(points, knbn, distance, hierarchy, nbconn, scale_modify_f, method, ef)
    out = diffusion.dmap_embed(small, DiffusionParams(dim, alfa, beta, epsil, time, gnbn, hierarchy))
    if outfile:
        write_coords_csv(out, outfile)
    return out


def graph_report(edges: DataFrame, sampling: int = 10_000) -> dict[str, DataFrame]:
    """Dimension, hubness and degree reports of a graph, by name."""
    counts = hubness.hubness(edges)
    return {
        "dimension": dimension.estimate(edges, sampling),
        "dimension_2nn": dimension.two_nn(edges, sampling),
        "hubness_skew": hubness.standard_third_moment(counts),
        "hubness_histogram": hubness.histogram(counts),
        "top_hubs": hubness.top_hubs(edges),
        "degrees": degree_summary(edges),
        "ranges": node_ranges(edges),
        "median_radius": radius_at_quantile(edges, 0.5).withColumn("fraction", F.lit(0.5)),
    }
