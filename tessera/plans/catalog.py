"""Queries of the library over the tables of a data folder, and their SQL for DuckDB.

Floating-point results are rounded on both sides, as the order of sums differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, entropy, vectors
from ..operators import carre, descent, diffusion, dimension, embedding, graph, hubness, knn, levels, linalg, mst, navigate, proba, quality
from ..operators.lineage import keep
from ..params import DiffusionParams, EmbedderParams, Epsil, Rank
from ..sources import exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 10
VARIABLE = DiffusionParams.variable_bandwidth()
FIXED = DiffusionParams()
WALK = DiffusionParams(alfa=0.0, beta=0.0, epsil=1.5, gnbn=12)


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")


def edges(spark: SparkSession, sf_dir: str, k: int = K, metric: str = "l2") -> DataFrame:
    p = points(spark, sf_dir)
    if metric in ("jeffreys", "jensen_shannon"):
        p = p.select("id", vectors.probability(F.col("v")).alias("v"))
    return keep(knn.knn(p, k, metric))  # read several times by what follows


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed coordinates: the first two components."""
    return points(spark, sf_dir).select("id", F.slice("v", 1, 2).alias("coords"))


# ---- SQL of the common tables -------------------------------------------------

E = "e as (select vec_id id, embedding::double[] v from embeddings where vec_id is not null and embedding is not null)"
PROB = "e as (select id, list_transform(v, lambda x: abs(x) / t) v from (select vec_id id, embedding::double[] v, list_sum(list_transform(embedding::double[], lambda x: abs(x))) t from embeddings))"
LN = "ln(greatest({}, 1e-30))"
BY = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: {}))"
X, Y = "a.v[i]", "b.v[i]"
SQL_DIST = {
    "l2": "list_distance(a.v, b.v)",
    "l1": BY.format(f"abs({X} - {Y})"),
    "cosine": "1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))",
    "jeffreys": BY.format(f"({X} - {Y}) * ({LN.format(X)} - {LN.format(Y)})"),
    "jensen_shannon": "sqrt(greatest(" + BY.format(f"({X} * ({LN.format(X)} - {LN.format(f'({X} + {Y}) / 2')}) + {Y} * ({LN.format(Y)} - {LN.format(f'({X} + {Y}) / 2')})) / 2") + ", 0))",
}


def knn_sql(k: int = K, metric: str = "l2", name: str = "k", src: str = "e") -> str:
    return f"""{name} as (select src, dst, dist, rank from (select *, row_number() over (partition by src order by dist, dst) rank from
 (select a.id src, b.id dst, {SQL_DIST[metric]} dist from {src} a join {src} b on a.id <> b.id)) where rank <= {k})"""


def dmap_sql(p: DiffusionParams) -> str:
    """Tables sc (scales), ker (kernel) of a diffusion map over e and k."""

    def ker(name: str, scales: str) -> str:
        even = "(hi is null or hi <= lo)"
        return f"""{name} as (select k.src, k.dst, case when {even} then 1 / (n + 1) else greatest(exp(-dist * dist / ({p.epsil} * a.s * b.s)), 1e-4) end w
 from k join ends on ends.src = k.src join {scales} a on a.id = k.src join {scales} b on b.id = k.dst
 union all select src, src, case when {even} then 1 / (n + 1) else 1.0 end from ends)"""

    used = "sum(dist * dist)" if p.gnbn is None else f"sum(case when rank <= {p.gnbn} then dist * dist else 0 end)"
    parts = [
        f"s0 as (select src id, sqrt({used} / count(*)) s from k group by src)",
        "sc as (select id, case when s <= 0 then mean else s end s, (case when s <= 0 then mean else s end) / mean normed, mean from s0, (select avg(s) mean from s0))",
        "ends as (select src, min(dist) lo, max(case when dist > 0 then dist end) hi, count(*)::double n from k group by src)",
    ]
    if p.beta < 0:
        parts += [ker("ker0", "sc"), sym_sql("g0", "ker0"), "q0 as (select src id, sum(w) q from g0 group by src)", f"bs as (select sc.id, pow(q0.q / m, {p.beta}) * sc.mean s from q0 join sc using (id), (select avg(q) m from q0))", ker("ker", "bs")]
    else:
        parts += ["cs as (select id, mean s from sc)", ker("ker", "cs")]
    return ", ".join(parts)


def sym_sql(name: str, ker: str) -> str:
    return f"{name} as (select src, dst, sum(w) w from (select src, dst, w / 2 w from {ker} union all select dst, src, w / 2 from {ker}) group by src, dst)"


def lap_sql(p: DiffusionParams) -> str:
    """Tables g (reweighted), n (norms), lap, walk over dmap_sql."""
    return f"""{sym_sql('g1', 'ker')}, q1 as (select id, pow(q / m, {p.alfa}) q from (select src id, sum(w) q from g1 group by src), (select avg(q) m from (select sum(w) q from g1 group by src))),
g as (select src, dst, w / (a.q * b.q) w from g1 join q1 a on a.id = src join q1 b on b.id = dst), n as (select src id, sqrt(sum(w)) norm from g group by src),
lap as (select src, dst, w / (a.norm * b.norm) w from g join n a on a.id = src join n b on b.id = dst),
walk as (select src, dst, w * b.norm / a.norm p from lap join n a on a.id = src join n b on b.id = dst)"""


def with_(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


P = f"""first as (select src id, dist d1 from k where rank = 1), pk as (select k.src, k.dst, dist, min(dist) over (partition by k.src) d0, max(dist) over (partition by k.src) top,
 (sum(coalesce(d1, 0)) over (partition by k.src) + min(dist) over (partition by k.src)) / (count(*) over (partition by k.src) + 1) scale from k left join first on first.id = k.dst),
p as (select src, dst, scale, raw / sum(raw) over (partition by src) w from (select *, case when top <= d0 or top <= 0 or scale <= 0 then 1.0 else greatest(exp(-greatest(dist - d0, 0) / scale), 1e-4) end raw from pk))"""
BASE = with_(E, knn_sql())
FLAT = "c as (select id, v[1:2] v from e)"
COUNTS = "h as (select e.id, count(k.src) hubness from e left join k on k.dst = e.id group by e.id)"
U = "((id * 2654435761) % 4294967296 + 1) / 4294967297.0"
M = 8
LV = f"lv as (select id, least(floor(-ln({U}) / ln({M})), 15)::int as level from e)"
PROJ = """hi as (select e.* from e join lv using (id) where level >= 1), lo as (select e.* from e join lv using (id) where level < 1),
proj as (select id, upper_id, dist from (select a.id, b.id upper_id, list_distance(a.v, b.v) dist, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) r from lo a, hi b) where r = 1 union all select id, id, 0.0 from hi)"""

# ---- neighbour graphs ----------------------------------------------------------


def _knn_query(metric: str):
    def f(spark, sf_dir):
        return edges(spark, sf_dir, K, metric).select("src", "dst", "rank", r6("dist").alias("dist"))

    f.__name__ = f"knn_{metric}"
    prob = metric in ("jeffreys", "jensen_shannon")
    query(with_(PROB if prob else E, knn_sql(K, metric)) + "select src, dst, rank::int as rank, round(dist, 6) dist from k")(f)


for _metric in vectors.COLUMNS:
    _knn_query(_metric)


@query(BASE + "select src, dst, rank::int as rank, round(dist, 6) dist from k")
def knn_column_path(spark, sf_dir):
    return knn.knn(points(spark, sf_dir), K, "l2", "sql").select("src", "dst", "rank", r6("dist").alias("dist"))


@query()
def knn_approximate(spark, sf_dir):
    return knn.knn(points(spark, sf_dir), K, "l2", "approx")


@query()
def knn_descent(spark, sf_dir):
    return descent.descent(points(spark, sf_dir), K)


@query(with_(E) + f"select count(*) * least({K}, count(*) - 1) nb_edges, true recalled from e")
def knn_descent_recall(spark, sf_dir):
    """Whether neighbour descent finds nine tenths of the exact neighbours."""
    found = keep(knn_descent(spark, sf_dir))
    recall = knn.recall(edges(spark, sf_dir), found).select((F.col("recall") >= 0.9).alias("recalled"))
    return found.agg(F.count(F.lit(1)).alias("nb_edges")).join(F.broadcast(recall), how="cross")


@query(with_(E) + "select count(*) nb_queries, true rises, true recalled from e where id % 10 = 3")
def search_recall(spark, sf_dir):
    """Points that an index of the others does not have are searched in it: whether longer lists find no less, and nine tenths of what there is."""
    p = points(spark, sf_dir)
    new, old = p.where("id % 10 = 3"), p.where("id % 10 <> 3")
    index, exact = navigate.build(old, levels.levels(old, M)), keep(knn.knn(old, K, queries=new))
    short, long = (knn.recall(exact, navigate.search(index, new, K, ef, enough=enough)).first()["recall"] for ef, enough in ((16, None), (128, 0.93)))
    return new.agg(F.count(F.lit(1)).alias("nb_queries"), F.lit(short <= long).alias("rises"), F.lit(long >= 0.9).alias("recalled"))


@query(with_(E) + "select count(*) nb_points, true recalled from e")
def projection_search(spark, sf_dir):
    """Whether nine tenths of the points are projected onto their nearest upper point by a search."""
    p = points(spark, sf_dir)
    lv = levels.levels(p, M)
    found = keep(navigate.project_by_search(p, lv, 1))
    same = found.join(levels.project(p, lv, 1).select("id", F.col("upper_id").alias("exact")), "id").agg((F.avg((F.col("upper_id") == F.col("exact")).cast("int")) >= 0.9).alias("recalled"))
    return found.agg(F.count(F.lit(1)).alias("nb_points")).join(F.broadcast(same), how="cross")


@query(with_(E, LV, "u as (select e.* from e join lv using (id) where level >= 1)", knn_sql(5, src="u")) + "select src, dst, rank::int as rank, round(dist, 6) dist from k")
def knn_layer(spark, sf_dir):
    p = points(spark, sf_dir)
    return levels.layer_knn(p, levels.levels(p, M), 1, 5).select("src", "dst", "rank", r6("dist").alias("dist"))


@query(with_(E, LV) + "select id, level from lv")
def sampling_levels(spark, sf_dir):
    return levels.levels(points(spark, sf_dir), M)


@query(with_(E, LV, PROJ) + "select id, upper_id, round(dist, 6) dist from proj")
def projection_edges(spark, sf_dir):
    p = points(spark, sf_dir)
    return levels.project(p, levels.levels(p, M), 1).select("id", "upper_id", r6("dist").alias("dist"))


BY_EDGES = """pe as (select id, upper_id, dist from (select k.src id, k.dst upper_id, k.dist, row_number() over (partition by k.src order by k.dist, k.dst) r from k join lv a on a.id = k.src join lv b on b.id = k.dst where a.level < 1 and b.level >= 1) where r = 1
 union all select id, id, 0.0 from lv where level >= 1)"""


@query(with_(E, LV, knn_sql(), BY_EDGES) + """, lost as (select id from lv where id not in (select id from pe)),
via as (select k.src id, pe.upper_id, pe.dist, row_number() over (partition by k.src order by k.rank) r from k join lost on lost.id = k.src join pe on pe.id = k.dst)
select id, upper_id, round(dist, 6) dist from pe union all select id, upper_id, round(dist, 6) from via where r = 1""")
def projection_fixed(spark, sf_dir):
    p, e = points(spark, sf_dir), edges(spark, sf_dir)
    lv = levels.levels(p, M)
    return levels.fix(levels.project_by_edges(e, lv, 1), e, lv).select("id", "upper_id", r6("dist").alias("dist"))


@query(with_(E, LV, PROJ) + "select unnest([0.05, 0.5, 0.95, 0.99])::double fraction, round(unnest(quantile_cont(dist, [0.05, 0.5, 0.95, 0.99])), 6) dist from proj")
def projection_quantiles(spark, sf_dir):
    p = points(spark, sf_dir)
    fractions = [0.05, 0.5, 0.95, 0.99]
    q = levels.projection_quantiles(levels.project(p, levels.levels(p, M), 1), fractions)
    return q.select(F.posexplode("quantiles").alias("k", "dist")).select(F.element_at(F.array(*map(F.lit, fractions)), F.col("k") + 1).alias("fraction"), r6("dist").alias("dist"))


# ---- statistics ------------------------------------------------------------------


@query(BASE + "select src id, round(min(dist), 6) d_min, round(max(dist), 6) d_max from k group by src")
def node_ranges(spark, sf_dir):
    return graph.node_ranges(edges(spark, sf_dir)).select("id", r6("d_min").alias("d_min"), r6("d_max").alias("d_max"))


@query(BASE + "select src id, round(max(dist), 6) dist from k group by src")
def max_edge(spark, sf_dir):
    return graph.max_edge(edges(spark, sf_dir)).select("id", r6("dist").alias("dist"))


@query(BASE + "select src id, round(1 / max(dist), 6) density from k group by src")
def density_index(spark, sf_dir):
    return graph.density_index(edges(spark, sf_dir)).select("id", r6("density").alias("density"))


@query(with_(E, knn_sql(), COUNTS) + "select id, hubness degree from h")
def in_degree(spark, sf_dir):
    return graph.in_degrees(edges(spark, sf_dir))


@query(with_(E, knn_sql(), COUNTS) + "select (select count(*) from e) nb_nodes, (select count(*) from k) nb_edges, round(avg(hubness))::bigint mean_in_degree, max(hubness) max_in_degree from h")
def graph_summary(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.size(e).select("nb_nodes", "nb_edges").join(F.broadcast(graph.degree_summary(e)), how="cross")


@query(BASE + "select round(quantile_cont(d, 0.5), 6) radius from (select min(dist) d from k group by src)")
def radius_quantile(spark, sf_dir):
    return graph.radius_at_quantile(edges(spark, sf_dir), 0.5).select(r6("radius").alias("radius"))


@query(with_(E) + "select id, row_number() over (order by id) - 1 idx from e")
def node_index(spark, sf_dir):
    return graph.node_index(points(spark, sf_dir))


@query(with_(E, knn_sql(), COUNTS) + "select id, hubness from h")
def hubness_counts(spark, sf_dir):
    return hubness.hubness(edges(spark, sf_dir))


@query(with_(E, knn_sql(), COUNTS) + "select round((sum(pow(hubness - m, 3)) / count(*)) / pow(max(s), 3), 6) skew from h, (select avg(hubness) m, stddev_samp(hubness) s from h)")
def hubness_skew(spark, sf_dir):
    return hubness.standard_third_moment(hubness.hubness(edges(spark, sf_dir))).select(r6("skew").alias("skew"))


@query(with_(E, knn_sql(), COUNTS) + "select unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999])::double fraction, round(unnest(quantile_cont(hubness, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999])), 6) hubness from h")
def hubness_quantiles(spark, sf_dir):
    return hubness.quantiles(hubness.hubness(edges(spark, sf_dir))).select("fraction", r6("hubness").alias("hubness"))


@query(with_(E, knn_sql(), COUNTS) + """, m as (select 2 * floor(sqrt(count(*))) most from h)
select (case when hubness < 1 or hubness > most then -1 else floor(hubness / pow(10, floor(log10(greatest(hubness, 1))))) * pow(10, floor(log10(greatest(hubness, 1)))) end)::bigint low, count(*) nb from h, m group by 1""")
def hubness_histogram(spark, sf_dir):
    return hubness.histogram(hubness.hubness(edges(spark, sf_dir)))


@query(with_(E, knn_sql(), COUNTS) + "select id, hubness from h order by hubness desc, id limit 20")
def top_hubs(spark, sf_dir):
    return hubness.top_hubs(edges(spark, sf_dir))


LB = """l as (select src id, list(dist order by rank) t from k group by src), lb as (select id, avg(d) dim from (select id, (q - 1) / list_sum(list_transform(range(1, q), lambda j: ln(t[q + 1] / t[j + 1]))) d from l, unnest(range(8, 20)) as u(q)) where d > 0 group by id)"""


@query(with_(E, knn_sql(20), LB) + "select id, round(dim, 6) dim from lb")
def dim_levina_bickel_by_id(spark, sf_dir):
    return dimension.by_node(edges(spark, sf_dir, 20)).select("id", r6("dim").alias("dim"))


@query(with_(E, knn_sql(20), LB) + "select round(avg(dim), 6) dim, round(stddev_pop(dim), 6) std, count(*) nb from lb")
def dim_levina_bickel(spark, sf_dir):
    return dimension.estimate(edges(spark, sf_dir, 20), None).select(r6("dim").alias("dim"), r6("std").alias("std"), "nb")


@query(BASE + """, r as (select src, max(case when rank = 2 then dist end) / max(case when rank = 1 then dist end) r from k group by src),
f as (select ln(r) x, -ln(1 - (row_number() over (order by r, src) - 1) / (count(*) over ())) y from r) select round(sum(x * y) / sum(x * x), 6) dim from f""")
def dim_two_nn(spark, sf_dir):
    return dimension.two_nn(edges(spark, sf_dir)).select(r6("dim").alias("dim"))


# ---- kernels ---------------------------------------------------------------------


@query(with_(E, knn_sql(), P) + "select src, dst, round(w, 6) w from p")
def proba_edges(spark, sf_dir):
    return proba.proba_edges(edges(spark, sf_dir)).select("src", "dst", r6("w").alias("w"))


@query(with_(E, knn_sql(), P) + "select src id, round(max(scale), 6) scale from p group by src")
def local_scales(spark, sf_dir):
    return proba.scales(proba.proba_edges(edges(spark, sf_dir))).select("id", r6("scale").alias("scale"))


@query(with_(E, knn_sql(), P) + "select src id, round(exp(sum(-w * ln(w))), 6) perplexity from p group by src")
def perplexity(spark, sf_dir):
    return proba.perplexities(proba.proba_edges(edges(spark, sf_dir))).select("id", r6("perplexity").alias("perplexity"))


@query(with_(E, knn_sql(), P, "s as (select src, dst, sum(w) w from (select src, dst, w / 2 w from p union all select dst, src, w / 2 from p) group by 1, 2)", "d as (select src id, sum(w) norm from s group by 1)") + "select s.src, s.dst, round(s.w / sqrt(a.norm * b.norm), 6) w from s join d a on a.id = s.src join d b on b.id = s.dst")
def legacy_laplacian(spark, sf_dir):
    return proba.legacy_laplacian(proba.proba_edges(edges(spark, sf_dir)))[0].select("src", "dst", r6("w").alias("w"))


RE = "select l_suppkey g, l_quantity / sum(l_quantity) over (partition by l_suppkey) p from lineitem"


@query(f"select g, round(-sum(p * ln(p)), 6) h_1, round(ln(sum(p * p)) / -1, 6) h_2, round(ln(sum(sqrt(p))) / 0.5, 6) h_0_5 from ({RE}) group by g")
def renyi_entropy(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("g"), "l_quantity")
    h = entropy.renyi_entropies(li, "l_quantity", [1.0, 2.0, 0.5], "g")
    return h.select("g", *[r6(c).alias(c) for c in h.columns if c != "g"])


RR = "select l_suppkey g, l_quantity / sum(l_quantity) over (partition by l_suppkey) p, l_extendedprice / sum(l_extendedprice) over (partition by l_suppkey) q from lineitem"


@query(f"select g, round(sum(p * ln(q / p)), 6) d_1, round(sum(p * pow(q / p, 2)), 6) d_2 from ({RR}) group by g")
def relative_renyi(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("g"), "l_quantity", "l_extendedprice")
    p = entropy.normalised(entropy.normalised(li, "l_quantity", "g").withColumnRenamed("p", "p0"), "l_extendedprice", "g")
    return p.groupBy("g").agg(*[r6(entropy.relative_renyi(F.col("p0"), F.col("p"), q)).alias(f"d_{q:g}") for q in (1.0, 2.0)])


@query(with_(E, knn_sql(), dmap_sql(FIXED)) + "select id, round(s, 6) s, round(normed, 6) normed from sc")
def dmap_scales(spark, sf_dir):
    return diffusion.node_scales(edges(spark, sf_dir), FIXED.gnbn).select("id", r6("s").alias("s"), r6("normed").alias("normed"))


@query(BASE + ", f as (select src id, dist d1 from k where rank = 1) select k.src id, round((sum(f.d1) + max(o.d1)) / (count(*) + 1), 6) s from k join f on f.id = k.dst join f o on o.id = k.src group by k.src")
def l1_scales(spark, sf_dir):
    return diffusion.l1_scales(edges(spark, sf_dir)).select("id", r6("s").alias("s"))


@query(with_(E, knn_sql(), dmap_sql(FIXED)) + "select src, dst, round(w, 6) w from ker")
def dmap_kernel(spark, sf_dir):
    return diffusion.dmap_kernel(edges(spark, sf_dir), FIXED)[0].select("src", "dst", r6("w").alias("w"))


@query(with_(E, knn_sql(), dmap_sql(VARIABLE)) + "select src, dst, round(w, 6) w from ker")
def dmap_kernel_variable(spark, sf_dir):
    return diffusion.dmap_kernel(edges(spark, sf_dir), VARIABLE)[0].select("src", "dst", r6("w").alias("w"))


@query(with_(E, knn_sql(), dmap_sql(VARIABLE)) + "select id, round(q / m, 6) q from q0, (select avg(q) m from q0)")
def dmap_density(spark, sf_dir):
    e = edges(spark, sf_dir)
    return diffusion.density(diffusion.kernel(e, diffusion.node_scales(e, VARIABLE.gnbn), VARIABLE.epsil)).select("id", r6("q").alias("q"))


@query(with_(E, knn_sql(), dmap_sql(VARIABLE)) + "select id, round(s, 6) s from bs")
def dmap_beta_scales(spark, sf_dir):
    e = edges(spark, sf_dir)
    s = diffusion.node_scales(e, VARIABLE.gnbn)
    return diffusion.beta_scales(diffusion.kernel(e, s, VARIABLE.epsil), s, VARIABLE.beta).select("id", r6("s").alias("s"))


@query(with_(E, knn_sql(), dmap_sql(FIXED), lap_sql(FIXED)) + "select src, dst, round(w, 6) w from lap")
def sym_kernel(spark, sf_dir):
    return diffusion.laplacian_of(edges(spark, sf_dir), FIXED).sym.select("src", "dst", r6("w").alias("w"))


@query(with_(E, knn_sql(), dmap_sql(FIXED), lap_sql(FIXED)) + "select src, dst, round(p, 6) p from walk")
def transition_rows(spark, sf_dir):
    return diffusion.laplacian_of(edges(spark, sf_dir), FIXED).transitions().select("src", "dst", r6("p").alias("p"))


@query(with_(E, knn_sql(), dmap_sql(FIXED), lap_sql(FIXED)) + "select src, dst, round(p / (a.normed * b.normed) - case when src = dst then 1 / (a.normed * a.normed) else 0 end, 6) w from walk join sc a on a.id = src join sc b on b.id = dst")
def generator(spark, sf_dir):
    return diffusion.laplacian_of(edges(spark, sf_dir), FIXED).generator().select("src", "dst", r6("w").alias("w"))


# ---- matrices --------------------------------------------------------------------


def _matrix(spark, sf_dir):
    return edges(spark, sf_dir).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("dist").alias("w"))


@query(BASE + "select src i, round(sum(dist * (dst % 7 - 3)), 6) y from k group by src")
def mat_vec(spark, sf_dir):
    v = points(spark, sf_dir).select(F.col("id").alias("j"), (F.col("id") % 7 - 3).cast("double").alias("y"))
    return linalg.mat_vec(_matrix(spark, sf_dir), v).select("i", r6("y").alias("y"))


@query(BASE + "select dst i, src j, round(2 * dist, 6) w from k")
def mat_transpose(spark, sf_dir):
    return linalg.scale(linalg.transpose(_matrix(spark, sf_dir)), 2.0).select("i", "j", r6("w").alias("w"))


@query(BASE + "select round(sqrt(sum(dist * dist)), 6) norm from k")
def frobenius(spark, sf_dir):
    return linalg.frobenius(_matrix(spark, sf_dir)).select(r6("norm").alias("norm"))


@query(BASE + "select dst i, round(sum(dist * e.v[1]), 6) x0, round(sum(dist * e.v[2]), 6) x1 from k join e on e.id = k.src group by dst")
def qt_a(spark, sf_dir):
    q = points(spark, sf_dir).select(F.col("id").alias("i"), F.slice("v", 1, 2).alias("x"))
    return linalg.qt_mat(q, _matrix(spark, sf_dir), 2).select("i", r6(F.col("x")[0]).alias("x0"), r6(F.col("x")[1]).alias("x1"))


def _lap(spark, sf_dir):
    return diffusion.laplacian_of(edges(spark, sf_dir), FIXED).sym.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w")


def _values(spark, s):
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "k int, sigma double")


@query()
def svd_full(spark, sf_dir):
    return _values(spark, linalg.full_values(_lap(spark, sf_dir)))


@query()
def svd_rank(spark, sf_dir):
    return _values(spark, linalg.svd(_lap(spark, sf_dir), Rank(20, 5))[0])


@query()
def laplacian_values(spark, sf_dir):
    """The 20 largest values of the normalised kernel, with bounds of their errors."""
    values, _, off = linalg.eigen(_lap(spark, sf_dir), 20)
    return spark.createDataFrame([(k, float(abs(v)), float(e)) for k, (v, e) in enumerate(zip(values, off, strict=True))], "k int, sigma double, bound double")


@query()
def svd_epsil(spark, sf_dir):
    """A range of 40 vectors at most, which this flat spectrum needs more of: values are lower bounds."""
    return _values(spark, linalg.svd(_lap(spark, sf_dir), Epsil(0.1, 20, 40))[0])


@query(with_(E) + "select 1.0::double sigma")
def first_singular_value(spark, sf_dir):
    """The walk's symmetric form has 1 as its largest singular value."""
    return spark.createDataFrame([(round(linalg.first_singular_value(_lap(spark, sf_dir), 1e-12), 6),)], "sigma double")


# ---- embeddings --------------------------------------------------------------------


@query()
def dmap_embed(spark, sf_dir):
    return diffusion.dmap_embed(edges(spark, sf_dir), VARIABLE)


@query()
def dmap_embed_hier(spark, sf_dir):
    p = points(spark, sf_dir)
    return diffusion.dmap_embed(levels.layer_knn(p, levels.levels(p, M), 1, 8), FIXED)


LOW = "low as (select id, 0.2 * least(greatest(scale / m, 0.25), 4.0) scale from (select src id, max(scale) scale from p group by src), (select avg(scale) m from (select max(scale) scale from p group by src)))"


@query(with_(E, knn_sql(), P, LOW) + "select id, round(scale, 6) scale from low")
def embedded_scales(spark, sf_dir):
    return embedding.embedded_scales(proba.scales(proba.proba_edges(edges(spark, sf_dir)))).select("id", r6("scale").alias("scale"))


@query(with_(E, knn_sql(), P, LOW, FLAT) + """, q as (select w, least(1 / (1 + pow(list_distance(a.v, b.v), 2) / (low.scale * low.scale)), 1 - 2.220446049250313e-16) c from p join low on low.id = p.src join c a on a.id = p.src join c b on b.id = p.dst)
select round(sum(-w * ln(c) - (1 - w) * ln(1 - c)), 4) ce from q""")
def cross_entropy(spark, sf_dir):
    k = proba.proba_edges(edges(spark, sf_dir))
    return embedding.cross_entropy(k, flat(spark, sf_dir), embedding.embedded_scales(proba.scales(k))).select(r6("ce", 4).alias("ce"))


@query(with_(E) + """, c as (select id, v[1] - (select avg(v[1]) from e) x, v[2] - (select avg(v[2]) from e) y from e), m as (select max(greatest(abs(x), abs(y))) / 5 m from c)
select id, round(x / m, 6) x, round(y / m, 6) y from c, m""")
def data_box(spark, sf_dir):
    return columns.data_box(flat(spark, sf_dir), 2, 10.0).select("id", r6(F.col("coords")[0]).alias("x"), r6(F.col("coords")[1]).alias("y"))


@query()
def entropy_embed(spark, sf_dir):
    return embedding.embed(edges(spark, sf_dir), EmbedderParams())


@query()
def entropy_embed_hier(spark, sf_dir):
    p = points(spark, sf_dir)
    lv = levels.levels(p, M)
    return embedding.hierarchical_embed(keep(levels.layer_knn(p, lv, 1, 8)), keep(levels.project(p, lv, 1)), edges(spark, sf_dir), EmbedderParams())


# ---- quality -------------------------------------------------------------------------

TE = "te as (select k.src, k.dst, k.rank, list_distance(a.v, b.v) length from k join c a on a.id = k.src join c b on b.id = k.dst)"
RAD = "rad as (select src, max(dist) radius from ck group by src)"


@query(with_(E, knn_sql(), FLAT, TE) + "select src, dst, rank::int as rank, round(min(length) over (partition by src order by rank), 6) length from te")
def transformed_edges(spark, sf_dir):
    return quality.transformed_edges(edges(spark, sf_dir), flat(spark, sf_dir), True).select("src", "dst", "rank", r6("length").alias("length"))


@query(with_(E, FLAT, knn_sql(15, name="ck", src="c"), RAD) + "select src id, round(radius, 6) dist from rad")
def embedded_radius(spark, sf_dir):
    return quality.embedded_radius(flat(spark, sf_dir), 15).select("id", r6("dist").alias("dist"))


@query(with_(E, knn_sql(), FLAT, TE, knn_sql(15, name="ck", src="c"), RAD) + """, m as (select src, sum((length <= radius)::int) m from te join rad using (src) group by src)
select sum((m = 0)::int)::bigint nb_without_match, round(avg(case when m > 0 then m end), 6) mean_matches from m""")
def quality_summary(spark, sf_dir):
    return quality.summary(edges(spark, sf_dir), flat(spark, sf_dir), 15).select("nb_without_match", r6("mean_matches").alias("mean_matches"))


@query(with_(E, knn_sql(), FLAT, TE, knn_sql(15, name="ck", src="c"), RAD) + "select te.src, dst, rank::int as rank, round(length / radius, 4) ratio from te join rad on rad.src = te.src")
def continuity_ratio(spark, sf_dir):
    return quality.continuity(edges(spark, sf_dir), flat(spark, sf_dir), 15).select("src", "dst", "rank", r6("ratio", 4).alias("ratio"))


@query(with_(E, knn_sql(), FLAT, TE) + "select src id, round(min(length), 6) dist from te group by src")
def first_dist(spark, sf_dir):
    return quality.first_dist(edges(spark, sf_dir), flat(spark, sf_dir)).select("id", r6("dist").alias("dist"))


# ---- carré du champ --------------------------------------------------------------------

C8 = "x as (select e.id, u.j - 1 j, e.v[u.j] x from e, (select unnest(range(1, 9)) j) u)"
WALK_SQL = (E, knn_sql(), dmap_sql(WALK), lap_sql(WALK))
MEAN = "mu as (select src id, j, sum(p * x) m from walk join x on x.id = walk.dst group by 1, 2)"
COV = "cov as (select walk.src id, a.j i, b.j j, sum(p * (a.x - ma.m) * (b.x - mb.m)) / (2 * max(sc.s) * max(sc.s)) c from walk join x a on a.id = walk.dst join x b on b.id = walk.dst join mu ma on ma.id = walk.src and ma.j = a.j join mu mb on mb.id = walk.src and mb.j = b.j join sc on sc.id = walk.src group by 1, 2, 3)"


def eight(spark, sf_dir):
    """The first eight components, to which the SQL of the queries that have some is held."""
    return points(spark, sf_dir).select("id", F.slice("v", 1, 8).alias("v"))


def _cov(spark, sf_dir):
    return keep(carre.covariance(carre.walk(edges(spark, sf_dir)), eight(spark, sf_dir)))


def _whole_cov(spark, sf_dir):
    """Covariances of whole vectors; not kept, as each is as large as the square of a vector and read once."""
    return carre.covariance(carre.walk(edges(spark, sf_dir)), points(spark, sf_dir))


@query(with_(*WALK_SQL, C8, MEAN) + "select id, j::int as j, round(m, 6) m from mu")
def cdc_mean(spark, sf_dir):
    return carre.means(carre.walk(edges(spark, sf_dir)), eight(spark, sf_dir)).select("id", "j", r6("m").alias("m"))


@query(with_(*WALK_SQL, C8, MEAN, COV) + "select id, i::int as i, j::int as j, round(c, 6) c from cov")
def cdc_cov(spark, sf_dir):
    c = _cov(spark, sf_dir).select("id", F.posexplode("cov").alias("k", "c"))
    return c.select("id", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).alias("j"), r6("c").alias("c"))


@query(with_(*WALK_SQL, C8, MEAN, COV) + "select id, round(sum(c), 6) trace from cov where i = j group by id")
def cdc_trace(spark, sf_dir):
    return carre.traces(_cov(spark, sf_dir)).select("id", r6("trace").alias("trace"))


@query(with_(*WALK_SQL, C8, MEAN, COV) + """, tr as (select id, sum(c) t from cov where i = j group by id), ab as (select a.src, a.dst, sum(x.c * y.c) m from k a join cov x on x.id = a.src join cov y on y.id = a.dst and y.i = x.j and y.j = x.i where a.rank = 1 group by 1, 2)
select src a, dst b, round(sqrt(greatest(x.t + y.t - 2 * sqrt(greatest(m, 0)), 0)), 4) dist from ab join tr x on x.id = src join tr y on y.id = dst""")
def cdc_distance(spark, sf_dir):
    pairs = edges(spark, sf_dir).where("rank = 1").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return carre.distances(_cov(spark, sf_dir), pairs).select("a", "b", r6("dist", 4).alias("dist"))


FG = "fg as (select e.id, i, j, e.v[i] f, e.v[j] * e.v[j] g from e, (select unnest(range(1, 3)) i), (select unnest(range(1, 65)) j)), mfg as (select src id, i, j, sum(p * f) mf, sum(p * g) mg from walk join fg on fg.id = walk.dst group by 1, 2, 3)"


@query(with_(*WALK_SQL, FG) + "select src id, (fg.i - 1)::int i, (fg.j - 1)::int j, round(sum(p * (f - mf) * (g - mg)) / (2 * max(sc.s) * max(sc.s)), 6) c from walk join fg on fg.id = walk.dst join mfg on mfg.id = walk.src and mfg.i = fg.i and mfg.j = fg.j join sc on sc.id = walk.src group by 1, 2, 3")
def cdc_vector_functions(spark, sf_dir):
    """Two functions of whole vectors: the first two components, and the squares of all."""
    c = carre.apply_fvec(carre.walk(edges(spark, sf_dir)), points(spark, sf_dir), lambda v: F.slice(v, 1, 2), lambda v: F.transform(v, lambda x: x * x))
    c = c.select("id", F.posexplode("cov").alias("k", "c"))
    return c.select("id", F.floor(F.col("k") / 64).cast("int").alias("i"), (F.col("k") % 64).alias("j"), r6("c").alias("c"))


@query(with_(*WALK_SQL) + ", x as (select e.id, u.j, e.v[u.j] x from e, (select unnest(range(1, 65)) j) u), mu as (select src id, j, sum(p * x) m from walk join x on x.id = walk.dst group by 1, 2) select walk.src id, round(sum(p * (x - m) * (x - m)) / (2 * max(sc.s) * max(sc.s)), 6) as trace from walk join x on x.id = walk.dst join mu on mu.id = walk.src and mu.j = x.j join sc on sc.id = walk.src group by 1")
def cdc_trace_whole(spark, sf_dir):
    return carre.traces(_whole_cov(spark, sf_dir)).select("id", r6("trace").alias("trace"))


@query(with_(*WALK_SQL) + "select src id, round(sum(p * v[1] * v[2]) - sum(p * v[1]) * sum(p * v[2]), 6) gamma from walk join e on e.id = walk.dst group by src")
def cdc_gamma(spark, sf_dir):
    values = points(spark, sf_dir).select("id", F.col("v")[0].alias("f"), F.col("v")[1].alias("g"))
    return carre.gamma(carre.walk(edges(spark, sf_dir)), values).select("id", r6("gamma").alias("gamma"))


@query(BASE + ", l as (select vec_id id, label from embeddings) select greatest(a.label, b.label) l1, least(a.label, b.label) l2, count(*) nb, round(avg(dist), 6) mean, round(stddev_pop(dist), 6) std from k join l a on a.id = src join l b on b.id = dst group by 1, 2")
def cdc_contingency(spark, sf_dir):
    l = labels(spark, sf_dir)  # noqa: E741
    e = edges(spark, sf_dir).join(l.select(F.col("id").alias("src"), F.col("label").alias("la")), "src").join(l.select(F.col("id").alias("dst"), F.col("label").alias("lb")), "dst")
    return carre.contingency(e).select("l1", "l2", "nb", r6("mean").alias("mean"), r6("std").alias("std"))


@query()
def cdc_spectrum(spark, sf_dir):
    return carre.spectra(_whole_cov(spark, sf_dir))


@query()
def cdc_spectrum_deciles(spark, sf_dir):
    return carre.spectrum_deciles(carre.spectra(_whole_cov(spark, sf_dir)))


@query("select label, min(vec_id) id from embeddings group by label")
def label_representatives(spark, sf_dir):
    return carre.representatives(labels(spark, sf_dir))


# ---- trees -------------------------------------------------------------------------------


@query()
def spanning_forest(spark, sf_dir):
    return mst.spanning_forest(edges(spark, sf_dir))


@query()
def single_linkage_labels(spark, sf_dir):
    return mst.single_linkage(edges(spark, sf_dir), 10)


@query()
def merge_tree(spark, sf_dir):
    return mst.merge_tree(edges(spark, sf_dir))


@query()
def h0_barcode(spark, sf_dir):
    return mst.h0_barcode(edges(spark, sf_dir))


# ---- exports and plots --------------------------------------------------------------------


@query(BASE + "select src i, dst j, round(dist, 6) d from k union all select dst, src, round(dist, 6) from k")
def ripser_triplets(spark, sf_dir):
    return exports.ripser_triplets(edges(spark, sf_dir)).select("i", "j", r6("d").alias("d"))


@query(with_(E) + """, q as (select row_number() over (order by d, id) - 1 r, v from (select id, v, sqrt(list_inner_product(v, v)) d from e) order by d, id limit 30)
select a.r::int r, b.r::int c, round(list_distance(a.v, b.v), 6) d from q a join q b on a.r >= b.r""")
def local_distance_matrix(spark, sf_dir):
    """Thirty points (the feature's own limit) round the origin."""
    m = exports.local_distance_matrix(points(spark, sf_dir), [0.0] * 64, 30)
    return m.select("r", "c", r6("d").alias("d"))


@query("select l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) l_quantity, round((l_extendedprice - me) / se, 6) l_extendedprice from lineitem, (select avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_extendedprice) me, stddev_samp(l_extendedprice) se from lineitem)")
def zscore(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    z = columns.zscore(li, ["l_quantity", "l_extendedprice"])
    return z.select("l_orderkey", "l_linenumber", r6("l_quantity").alias("l_quantity"), r6("l_extendedprice").alias("l_extendedprice"))


GRID = """pts as (select id, v[1] x, v[2] y, abs(v[3]) value from e), b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from pts),
cell as (select id, value, floor({n} * (x - x0) / (x1 - x0))::int gx, floor({n} * (y - y0) / (y1 - y0))::int gy from pts, b)"""


def _plot(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.abs(F.col("v")[2]).alias("value"))


@query(with_(E, GRID.format(n=30)) + """, c as (select gx, gy, avg(value) m from cell group by 1, 2), s as (select min(m) least, sqrt((sum(m * m) - sum(m) * sum(m) / 961.0) / 960.0) dev from c where m > 0)
select gx, gy, round(exp(-(m - least) / (2 * dev)), 6) as value from c, s""")
def distance_grid(spark, sf_dir):
    return exports.distance_grid(_plot(spark, sf_dir), 31).select("gx", "gy", r6("value").alias("value"))


@query(with_(E, GRID.format(n=30)) + "select gx, gy, round(least(ln(greatest(arg_max(value * 10, id), 1)), 2), 6) as value from cell group by 1, 2")
def continuity_grid(spark, sf_dir):
    return exports.continuity_grid(_plot(spark, sf_dir).withColumn("value", F.col("value") * 10), 31).select("gx", "gy", r6("value").alias("value"))


@query(with_(E) + """, m as (select avg(v[1]) mx, stddev_samp(v[1]) sx, avg(v[2]) my, stddev_samp(v[2]) sy from e)
select e.id, l.label, dense_rank() over (order by l.label) color, round(greatest(least(v[1], mx + sx), mx - sx), 6) x, round(greatest(least(v[2], my + sy), my - sy), 6) y from e join embeddings l on l.vec_id = e.id, m""")
def label_plot(spark, sf_dir):
    p = _plot(spark, sf_dir).join(labels(spark, sf_dir), "id")
    return exports.label_plot(p, 1.0).select("id", "label", "color", r6("x").alias("x"), r6("y").alias("y"))


@query("select round(corr(l_quantity, l_extendedprice), 6) r from lineitem")
def correlation(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.agg(r6(columns.correlation(F.col("l_quantity"), F.col("l_extendedprice"))).alias("r"))
