"""Queries of the graph, alignment, geometry, batching and model operators over the driver's tables, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import equations as eq
from .functions.geometry import contact_edges, disk_mask, polygon_metrics
from .functions.strings import cluster_label, short, slug
from .functions.text_keys import id_key
from .operators import alignment as al
from .operators import batching as ba
from .operators import graph as gr
from .operators import images as im
from .operators import model as mo
from .operators import vector_quality as vq
from .plans.cell_graph import CANDIDATE_UM
from .operators.proximity import locate_in_regions, usable
from .sources.slides import first_gene_group, gene_group_map
from .streaming.ingest import sessions, tumbling


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def _metric(c: str):
    return F.when(~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c))


def edges(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """kind, i < j and the largest valid value of each metric over an edge's deliveries."""
    e = _read(spark, d, "cell_edges").withColumn("kind", F.lower(F.trim("kind"))).filter(F.col("kind") == kind if kind else F.col("kind").isNotNull())
    return e.groupBy("kind", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(*(F.max(_metric(c)).alias(c) for c in ("shared_wall_um", "centroid_dist_um", "wall_dist_um")))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One row per cell: cell_ix, sample_id, cell_key, x_um, y_um (null without a location), area_um2, and the first loaded_at."""
    c = _read(spark, d, "cells")
    ok = usable("spatial_x", "spatial_y")
    pos = lambda a: F.min(F.when(ok, F.col(a) * F.col("microns_per_pixel")))
    return c.groupBy("cell_ix").agg(F.min("sample_id").alias("sample_id"), F.min(id_key("cell_id")).alias("cell_key"), pos("spatial_x").alias("x_um"), pos("spatial_y").alias("y_um"), F.min(F.when(~F.isnan("area_um2") & (F.col("area_um2") > 0), F.col("area_um2"))).alias("area_um2"), F.min("loaded_at").alias("loaded_at"))


def types(spark: SparkSession, d: str) -> DataFrame:
    """cell_ix, type: the label of the cell's last loaded row (ties: the higher row_id) in lower case, unassigned where there is none."""
    g = _read(spark, d, "cell_groups").select("sample_id", id_key("cell_id").alias("cell_key"), F.lower(F.trim("group_name")).alias("label"), "loaded_at", "row_id").dropna(subset=["sample_id", "cell_key"])
    last = g.groupBy("sample_id", "cell_key").agg(F.max_by("label", F.struct("loaded_at", "row_id")).alias("label"))
    return cells(spark, d).join(last, ["sample_id", "cell_key"], "left").select("cell_ix", al.folded_label("label", "unassigned").alias("type"))


_M = lambda c: f"max({c}) filter (where not isnan({c}) and {c} >= 0 and not isinf({c})) {c}"
E_SQL = f"""e as (select lower(trim(kind)) kind, least(i, j) i, greatest(i, j) j, {_M('shared_wall_um')}, {_M('centroid_dist_um')}, {_M('wall_dist_um')} from cell_edges where kind is not null group by all)"""
V_SQL = E_SQL + ", v as (select * from e where kind = 'voronoi'), dir as (select j dst, i src, true into_j, * from v union all select i, j, false, * from v)"
_OK = "spatial_x is not null and spatial_y is not null and not isnan(spatial_x) and not isnan(spatial_y) and not (spatial_x = 0 and spatial_y = 0)"
C_SQL = f"""c as (select cell_ix, min(sample_id) sample_id, min(lower(trim(cell_id))) cell_key, min(spatial_x * microns_per_pixel) filter (where {_OK}) x_um, min(spatial_y * microns_per_pixel) filter (where {_OK}) y_um,
  min(area_um2) filter (where not isnan(area_um2) and area_um2 > 0) area_um2, min(loaded_at) loaded_at from cells group by 1)"""
T_SQL = C_SQL + """, g as (select sample_id, lower(trim(cell_id)) cell_key, lower(trim(group_name)) l, row_number() over (partition by sample_id, lower(trim(cell_id)) order by loaded_at desc, row_id desc) r from cell_groups where cell_id is not null and sample_id is not null),
t as (select cell_ix, case when l is null or l = '' then 'unassigned' else l end as type from c left join (select * from g where r = 1) g using (sample_id, cell_key))"""
BETA_SQL = "beta as (select dst, src, into_j, raw / greatest(sum(raw) over (partition by dst), 1e-12) beta from (select dst, src, into_j, coalesce(shared_wall_um, 0) * exp(-coalesce(centroid_dist_um, 0) / 20) raw from dir))"
NICHE_SQL = "n as (select dst, type, count(*) / cast(sum(count(*)) over (partition by dst) as double) share from dir join t on t.cell_ix = src group by dst, type)"
COMP_SQL = "comp as (select o.type, n.type neighbour_type, sum(share) / max(s.support) share, max(s.support) support from n join t o on o.cell_ix = dst join (select o.type, count(distinct dst) support from n join t o on o.cell_ix = dst group by 1) s on s.type = o.type group by 1, 2)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Graphs


@query(f"with {E_SQL} select kind, i, j, round(shared_wall_um, 6) shared_wall_um, round(centroid_dist_um, 6) centroid_dist_um, round(wall_dist_um, 6) wall_dist_um from e")
def edges_canonical(spark, d):
    return edges(spark, d).select("kind", "i", "j", *(_r(c, c) for c in ("shared_wall_um", "centroid_dist_um", "wall_dist_um")))


@query(f"with {V_SQL} select dst, src, into_j, round(centroid_dist_um, 6) centroid_dist_um from dir")
def edges_symmetric(spark, d):
    return gr.directed(edges(spark, d, "voronoi"), ["centroid_dist_um"]).withColumn("centroid_dist_um", F.round("centroid_dist_um", 6))


@query(f"with {V_SQL} select c.cell_ix, count(dst) degree from (select distinct cell_ix from cells) c left join dir on dst = c.cell_ix group by 1")
def graph_degrees(spark, d):
    return gr.degrees(_read(spark, d, "cells"), "cell_ix", edges(spark, d, "voronoi"))


@query(f"""with {E_SQL}, dir as (select kind, i dst from e union all select kind, j from e), deg as (select k.kind, c.cell_ix, count(dst) degree from (select distinct cell_ix from cells) c cross join (values ('voronoi'), ('contact')) k(kind) left join dir on dst = c.cell_ix and dir.kind = k.kind group by all)
select kind, (select count(*) from e where e.kind = deg.kind) n_edges, round(avg(degree), 6) mean_degree, round(avg(cast(degree = 0 as int)), 6) isolated_fraction, (select round(median(shared_wall_um), 6) from e where e.kind = deg.kind) median_wall_um from deg group by kind""")
def graph_summary(spark, d):
    e = edges(spark, d)
    parts = [gr.degrees(_read(spark, d, "cells"), "cell_ix", e.filter(F.col("kind") == k)).withColumn("kind", F.lit(k)) for k in ("voronoi", "contact")]
    out = gr.graph_summary(parts[0].unionByName(parts[1]), e, "kind", "shared_wall_um")
    return out.select("kind", "n_edges", *(_r(c, c) for c in ("mean_degree", "isolated_fraction", "median_wall_um")))


@query(f"with {E_SQL} select kind, i, j from e where wall_dist_um <= 2 and shared_wall_um >= 3 and centroid_dist_um <= 20")
def edge_filter(spark, d):
    return gr.filter_edges(edges(spark, d), max_gap=2.0, min_wall=3.0, max_centroid=20.0).select("kind", "i", "j")


@query(f"with {E_SQL} select kind, i, j from e where wall_dist_um = 0")
def touching_edges(spark, d):
    return edges(spark, d).filter("wall_dist_um = 0").select("kind", "i", "j")


@query(f"with {E_SQL}, {C_SQL}, w as (select cell_ix from c where x_um between 200 and 600 and y_um between 200 and 600) select kind, i, j from e where i in (select cell_ix from w) and j in (select cell_ix from w)")
def region_window(spark, d):
    return gr.within_window(cells(spark, d), edges(spark, d), "cell_ix", "x_um", "y_um", (200, 200, 600, 600)).select("kind", "i", "j")


@query(f"with {V_SQL}, {BETA_SQL} select dst, src, into_j, round(beta, 6) beta from beta")
def edge_beta(spark, d):
    return gr.smoothing_weights(edges(spark, d, "voronoi"), "shared_wall_um", "centroid_dist_um").withColumn("beta", F.round("beta", 6))


@query(f"with {V_SQL}, {BETA_SQL} select dst, round(sum(beta), 6) total from beta group by 1")
def beta_row_sums(spark, d):
    return gr.smoothing_weights(edges(spark, d, "voronoi"), "shared_wall_um", "centroid_dist_um").groupBy("dst").agg(_r(F.sum("beta"), "total"))


@query(f"with {V_SQL}, {T_SQL}, {NICHE_SQL} select dst, type, round(share, 6) share from n")
def niche(spark, d):
    return gr.niche(edges(spark, d, "voronoi"), types(spark, d), "cell_ix", "type").withColumn("share", F.round("share", 6))


@query(f"with {V_SQL}, {T_SQL}, {NICHE_SQL}, {COMP_SQL} select type, neighbour_type, round(share, 6) share, support from comp")
def composition(spark, d):
    t = types(spark, d)
    return gr.composition(gr.niche(edges(spark, d, "voronoi"), t, "cell_ix", "type"), t, "cell_ix", "type").withColumn("share", F.round("share", 6))


@query(f"""with {E_SQL}, v as (select * from e where kind = 'voronoi' and centroid_dist_um <= 40), dir as (select j dst, i src, true into_j, * from v union all select i, j, false, * from v), {BETA_SQL} select dst, src, round(beta, 6) beta from beta""")
def model_graph(spark, d):
    kept, _ = gr.prune(edges(spark, d, "voronoi"), "centroid_dist_um")
    return gr.smoothing_weights(kept, "shared_wall_um", "centroid_dist_um").select("dst", "src", _r(F.col("beta"), "beta"))


@query(f"with {V_SQL} select dst, count(*) n_pruned from dir where centroid_dist_um is null or centroid_dist_um > 40 group by 1")
def pruned_per_cell(spark, d):
    return gr.prune(edges(spark, d, "voronoi"), "centroid_dist_um")[1]


_VOR_SQL = f"""with {C_SQL}, p as (select sample_id s, x_um x, y_um y, min(cell_ix) id from c where x_um is not null group by 1, 2, 3),
nb as (select a.s, a.id i, b.id j, b.x - a.x dx, b.y - a.y dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) r from p a join p b on a.s = b.s and a.id <> b.id and b.x between a.x - 60 and a.x + 60 and b.y between a.y - 60 and a.y + 60
  where (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 3600),
tri as (select n.s, n.i, n.j, n.r, (k.dx * k.dx + k.dy * k.dy - n.dx * k.dx - n.dy * k.dy) / 2 rhs, (-n.dy * k.dx + n.dx * k.dy) / n.r ne from (select * from nb where i < j) n left join nb k on k.i = n.i and k.j <> n.j),
lim as (select s, i, j, r, min(case when ne > 0 then rhs / ne end) hi, max(case when ne < 0 then rhs / ne end) lo, coalesce(bool_or(ne = 0 and rhs < 0), false) dead from tri group by 1, 2, 3, 4),
f as (select *, sqrt(greatest(900 - r * r / 4, 0)) h from lim where not dead)
select s as sample_id, i, j, round(least(coalesce(hi, h), h) - greatest(coalesce(lo, -h), -h), 4) as face_um, round(r, 4) as distance_um from f where least(coalesce(hi, h), h) - greatest(coalesce(lo, -h), -h) > 1e-9"""


@query(_VOR_SQL)
def voronoi_edges(spark, d):
    v = gr.voronoi_edges(cells(spark, d).dropna(subset=["x_um", "y_um"]), "sample_id", "cell_ix", "x_um", "y_um")
    return v.select(F.col("space").alias("sample_id"), "i", "j", F.round("face", 4).alias("face_um"), F.round("distance", 4).alias("distance_um"))


# Alignment and labels


@query(f"with {C_SQL}, x as (select sample_id, lower(trim(cell_id)) cell_key, row_id, row_number() over (partition by sample_id, lower(trim(cell_id)) order by loaded_at, row_id) r from cell_groups where cell_id is not null) select cell_ix, row_id from c join x using (sample_id, cell_key) where r = 1")
def align_inner(spark, d):
    g = _read(spark, d, "cell_groups").select("sample_id", id_key("cell_id").alias("cell_key"), "row_id", "loaded_at")
    return cells(spark, d).select("cell_ix", "sample_id", "cell_key").join(al.keep_first(g, ["sample_id", "cell_key"], ["loaded_at", "row_id"]).select("sample_id", "cell_key", "row_id"), ["sample_id", "cell_key"]).select("cell_ix", "row_id")


@query(f"with {C_SQL}, x as (select sample_id, lower(trim(cell_id)) cell_key, color, row_number() over (partition by sample_id, lower(trim(cell_id)) order by loaded_at, row_id) r from cell_groups where cell_id is not null) select cell_ix, color, r is not null as found from c left join (select * from x where r = 1) x using (sample_id, cell_key)")
def labels_left_join(spark, d):
    g = _read(spark, d, "cell_groups").select("sample_id", id_key("cell_id").alias("cell_key"), "color", F.col("loaded_at").alias("group_loaded_at"), "row_id")
    return al.left_attach(cells(spark, d).select("cell_ix", "sample_id", "cell_key"), g, ["sample_id", "cell_key"], ["group_loaded_at", "row_id"], "found").select("cell_ix", "color", "found")


@query("select row_id, case when group_name is null or lower(trim(group_name)) = 'unassigned' or trim(group_name) = '' then 'Unassigned' else group_name end as label from cell_groups")
def label_fold(spark, d):
    return _read(spark, d, "cell_groups").select("row_id", al.folded_label("group_name").alias("label"))


@query("""with x as (select sample_id, lower(trim(barcode)) k, clustering, cluster_no, row_number() over (partition by sample_id, lower(trim(barcode)), clustering order by loaded_at, row_id) r from clusters where barcode is not null)
select sample_id, k as cell_key, max('Cluster-' || cluster_no) filter (where clustering = 'graphclust') as graphclust, max('Cluster-' || cluster_no) filter (where clustering = 'kmeans_6_clusters') as kmeans_6_clusters from x where r = 1 group by 1, 2""")
def cluster_pivot(spark, d):
    c = _read(spark, d, "clusters").select("sample_id", id_key("barcode").alias("cell_key"), "clustering", "cluster_no", "loaded_at", "row_id")
    return al.pivot_clusterings(c, ["sample_id", "cell_key"], "clustering", "cluster_no", ["loaded_at", "row_id"], ["graphclust", "kmeans_6_clusters"])


@query("select row_id, 'Cluster-' || cluster_no as label from clusters")
def cluster_labels(spark, d):
    return _read(spark, d, "clusters").select("row_id", cluster_label("cluster_no").alias("label"))


@query(f"with {T_SQL} select type, dense_rank() over (order by type) - 1 as code from (select distinct type from t)")
def type_codes(spark, d):
    return al.dense_codes(types(spark, d), "type")


@query("select sample_id, row_number() over (order by o, sample_id) - 1 as code from (select sample_id, min(cell_ix) o from cells group by 1)")
def codes_by_appearance(spark, d):
    return al.codes_by_appearance(_read(spark, d, "cells"), "sample_id", "cell_ix")


@query("""with b as (select node_id, image_embedding v, row_number() over (partition by node_id order by seed_id) r from batch_seeds)
select c.cell_ix, b.v is not null as found, b.v[1] as first_entry from (select cell_ix, min(lower(trim(cell_id))) k from cells group by 1) c left join (select lower(trim(node_id)) k, v from b where r = 1) b on b.k = c.k""")
def embeddings_align(spark, d):
    one = al.keep_first(_read(spark, d, "batch_seeds").select("node_id", "image_embedding", "seed_id"), ["node_id"], ["seed_id"]).select(id_key("node_id").alias("cell_key"), "image_embedding")
    c = cells(spark, d).select("cell_ix", "cell_key")
    return c.join(one, "cell_key", "left").select("cell_ix", F.col("image_embedding").isNotNull().alias("found"), F.col("image_embedding")[0].alias("first_entry"))


@query(r"""with s as (select doc_id, coalesce(source, 'none') || '/' || coalesce(sample_id, 'Slide') || case when doc_id % 3 = 0 then '_XRrun_outs.zip' when doc_id % 3 = 1 then '.tar.gz/outs' else ' (B)' end p from documents),
u as (select doc_id, p, case when p like '%/outs' then split_part(p, '/', 2) else split_part(p, '/', 2) end l from s)
select doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '\.zip$', '', 'i'), '\.tar\.gz$', '', 'i'), '_outs$', '', 'i'), '_xrrun$', '', 'i')), '[^a-z0-9]+', '_', 'g'), '_') as name from u""")
def slug_names(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, "_XRrun_outs.zip").when(F.col("doc_id") % 3 == 1, ".tar.gz/outs").otherwise(" (B)")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("sample_id", F.lit("Slide")), tail)
    return _read(spark, d, "documents").select("doc_id", slug(path).alias("name"))


@query("select p_brand, min(p_type) as gene_group from part group by 1")
def gene_group_first(spark, d):
    return first_gene_group(_read(spark, d, "part"), "p_brand", "p_type")


@query("select p_type, list_sort(list(distinct p_brand)) as genes from part group by 1")
def gene_groups_map(spark, d):
    return gene_group_map(_read(spark, d, "part"), "p_brand", "p_type")


@query("select p_partkey, case when r = 1 then p_name else p_name || '-' || (r - 1) end as name from (select *, row_number() over (partition by p_name order by p_partkey) r from part)")
def unique_names(spark, d):
    return _read(spark, d, "part").select("p_partkey", al.unique_names("p_name", "p_partkey").alias("name"))


@query("select doc_id, case when length(text) > 20 then substring(text, 1, 19) || '…' else text end as title from documents")
def short_titles(spark, d):
    return _read(spark, d, "documents").select("doc_id", short("text", 20).alias("title"))


@query(f"with {C_SQL}, z as (select * from c where x_um is not null), m as (select median(x_um) mx, median(y_um) my from z) select cell_ix from z, m order by sqrt((x_um - mx) * (x_um - mx) + (y_um - my) * (y_um - my)), cell_ix limit 500")
def nearest_to_median(spark, d):
    return al.nearest_to_median(cells(spark, d).dropna(subset=["x_um", "y_um"]), "x_um", "y_um", "cell_ix", 500).select("cell_ix")


@query(f"with {T_SQL} select type, count(*) n, round(count(*) / cast(sum(count(*)) over () as double), 6) share from t group by 1")
def label_counts(spark, d):
    n = types(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("type", "n", _r(F.col("n") / F.col("all"), "share"))


@query("select sample_id, round(avg(cast(coalesce(found, false) as int)), 6) as coverage from batch_seeds group by 1")
def embedding_coverage(spark, d):
    return _read(spark, d, "batch_seeds").groupBy("sample_id").agg(_r(F.avg(F.coalesce("found", F.lit(False)).cast("int")), "coverage"))


@query(f"""with {E_SQL}, c as (select distinct cell_ix from cells) select 'self_loop' as violation, count(*) as n from e where i = j union all select 'unknown_end', count(*) from e where i not in (select cell_ix from c) or j not in (select cell_ix from c)
union all select 'wall_beyond_centroid', count(*) from e where wall_dist_um > centroid_dist_um union all select 'face_of_zero', count(*) from e where kind = 'voronoi' and coalesce(shared_wall_um, 0) = 0""")
def structural_checks(spark, d):
    e, c = edges(spark, d), _read(spark, d, "cells").select("cell_ix").distinct()
    known = e.join(c.withColumnRenamed("cell_ix", "i"), "i", "left_semi").join(c.withColumnRenamed("cell_ix", "j"), "j", "left_semi").agg(F.count(F.lit(1)).alias("k"))
    one = e.agg(F.count(F.lit(1)).alias("t"), F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(0)).alias("self_loop"), F.sum(F.when(F.col("wall_dist_um") > F.col("centroid_dist_um"), 1).otherwise(0)).alias("wall_beyond_centroid"), F.sum(F.when((F.col("kind") == "voronoi") & (F.coalesce("shared_wall_um", F.lit(0.0)) == 0), 1).otherwise(0)).alias("face_of_zero"))
    row = one.crossJoin(F.broadcast(known)).withColumn("unknown_end", F.col("t") - F.col("k"))
    return row.unpivot([], ["self_loop", "unknown_end", "wall_beyond_centroid", "face_of_zero"], "violation", "n")


# Geometry: outlines are octagons with a cell's area around its position


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """cell_ix, sample_id, x_um, y_um, r, xs, ys: a regular octagon of each cell's area."""
    c = cells(spark, d).dropna(subset=["x_um", "y_um", "area_um2"]).withColumn("r", F.sqrt(F.col("area_um2") / (2 * math.sqrt(2))))
    ring = lambda f, at: F.array(*(F.col(at) + F.col("r") * f(2 * math.pi * k / 8) for k in range(8)))
    return c.select("cell_ix", "sample_id", "x_um", "y_um", "r", "area_um2", ring(math.cos, "x_um").alias("xs"), ring(math.sin, "y_um").alias("ys"))


_OCT = f"{C_SQL}, o as (select *, sqrt(area_um2 / (2 * sqrt(2))) r from c where x_um is not null and area_um2 is not null)"


@query(f"""with {_OCT} select cell_ix, round(area_um2, 4) as area_um2, round(16 * r * sin(pi() / 8), 4) as perimeter_um, round(x_um + 1e-7, 4) as centroid_x, round(y_um + 1e-7, 4) as centroid_y, round(4 * pi() * area_um2 / power(16 * r * sin(pi() / 8), 2), 4) as circularity, cast(1 as double) as solidity, round(2 * sqrt(area_um2 / pi()), 4) as equiv_diameter_um from o""")
def polygon_metrics_table(spark, d):
    m = outlines(spark, d).withColumn("m", polygon_metrics("xs", "ys", F.lit(1.0)))
    return m.select("cell_ix", *(F.round(F.col(f"m.{c}") + 1e-7 * c.startswith("centroid"), 4).alias(c) for c in ("area_um2", "perimeter_um", "centroid_x", "centroid_y", "circularity", "solidity", "equiv_diameter_um")))  # no ties in rounding


@query(f"with {_OCT} select cell_ix, round(r, 6) as covering_radius_um from o")
def covering_radius(spark, d):
    v = outlines(spark, d).select("cell_ix", "x_um", "y_um", F.explode(F.arrays_zip("xs", "ys")).alias("v"))
    return v.groupBy("cell_ix").agg(_r(F.max(F.hypot(F.col("v.xs") - F.col("x_um"), F.col("v.ys") - F.col("y_um"))), "covering_radius_um"))


@query("select l_orderkey as cell_id, count(*) as n_vertices from lineitem group by 1 having count(*) >= 4")
def vertex_filter(spark, d):
    return _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.count(F.lit(1)).alias("n_vertices")).filter("n_vertices >= 4")


@query(f"""with {C_SQL}, z as (select * from c where x_um is not null), b as (select sample_id, min(x_um) x0, max(x_um) x1, min(y_um) y0, max(y_um) y1 from z group by 1),
h as (select sample_id, cast(least(floor((x_um - x0) / greatest(x1 - x0, 1e-9) * 40), 39) as int) bx, cast(least(floor((y_um - y0) / greatest(y1 - y0, 1e-9) * 40), 39) as int) as by_, count(*) n from z join b using (sample_id) group by 1, 2, 3)
select sample_id, bx, by_ as "by", n from (select *, row_number() over (partition by sample_id order by n desc, bx, by_) r from h) where r = 1""")
def densest_region(spark, d):
    return vq.densest_region(cells(spark, d).dropna(subset=["x_um", "y_um"]), "sample_id", "x_um", "y_um")


@query()
def contact_graph(spark, d):
    """Outlines at most 1 µm apart with their common and apposed walls; tested against single pairs."""
    o = outlines(spark, d)
    near = gr.voronoi_edges(o, "sample_id", "cell_ix", "x_um", "y_um", clip=CANDIDATE_UM / 2)
    return contact_edges(near, o, "cell_ix", "xs", "ys", 1.0, 1.0).select("i", "j", *(_r(F.col(c), c) for c in ("wall_dist_um", "shared_wall_um", "apposed_wall_um")))


@query(f"""with {C_SQL}, q as (select * from c where x_um is not null and y_um is not null) select cell_ix, sample_id || ':' || cast(floor(x_um / 250) as bigint) || ':' || cast(floor(y_um / 250) as bigint) as region from q""")
def regions_of_cells(spark, d):
    """The square of a 250 µm grid that contains each cell, found as a point in polygons."""
    c = cells(spark, d).dropna(subset=["x_um", "y_um"])
    box = c.groupBy("sample_id").agg(F.floor(F.min("x_um") / 250).alias("a"), F.floor(F.max("x_um") / 250).alias("b"), F.floor(F.min("y_um") / 250).alias("e"), F.floor(F.max("y_um") / 250).alias("f"))
    g = box.select("sample_id", F.explode(F.sequence("a", "b")).alias("gx"), "e", "f").select("sample_id", "gx", F.explode(F.sequence("e", "f")).alias("gy"))
    p = lambda x, y: F.struct(((F.col("gx") + x) * 250.0).alias("x"), ((F.col("gy") + y) * 250.0).alias("y"))
    regions = g.select("sample_id", F.concat_ws(":", "sample_id", "gx", "gy").alias("region"), F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1)).alias("ring"))
    return locate_in_regions(c, regions, "sample_id", "cell_ix", "x_um", "y_um", "region", "ring", 250.0).select(F.col("id").alias("cell_ix"), "region")


# Batches, tiles and splits


_H = "cast((cast({0} as hugeint) * 2654435761) % 4294967296 as bigint)"


@query(f"select cell_ix, (r - 1) // 64 as batch_id, cast((r - 1) % 64 as int) as seed_index from (select cell_ix, row_number() over (order by {_H.format('cell_ix')}, cell_ix) r from (select distinct cell_ix from cells))")
def epoch_batches(spark, d):
    return ba.epoch_batches(_read(spark, d, "cells"), "cell_ix")


_B = "b as (select distinct batch_id, node_index id from batch_seeds where node_index is not null)"


@query(f"with {V_SQL}, {_B} select batch_id, dst, src from b join dir on dst = id")
def batch_edges(spark, d):
    return ba.batch_edges(_read(spark, d, "batch_seeds"), "batch_id", "node_index", edges(spark, d, "voronoi"))


@query(f"with {V_SQL}, {_B}, a as (select batch_id, id, 1 s from b union all select batch_id, src, 0 from b join dir on dst = id) select batch_id, id, max(s) = 1 as is_seed, row_number() over (partition by batch_id order by id) - 1 as local_ix from a group by 1, 2")
def batch_nodes(spark, d):
    return ba.batch_nodes(_read(spark, d, "batch_seeds"), "batch_id", "node_index", edges(spark, d, "voronoi"))


@query(f"with {V_SQL}, {T_SQL}, {NICHE_SQL}, {COMP_SQL}, {_B} select batch_id, id, neighbour_type, round(share, 6) share from b join t on t.cell_ix = id join comp using (type)")
def seed_composition(spark, d):
    t = types(spark, d)
    table = gr.composition(gr.niche(edges(spark, d, "voronoi"), t, "cell_ix", "type"), t, "cell_ix", "type")
    seeds = _read(spark, d, "batch_seeds").select("batch_id", F.col("node_index").alias("id")).dropna().distinct()
    return seeds.join(t.withColumnRenamed("cell_ix", "id"), "id").join(table, "type").select("batch_id", "id", "neighbour_type", _r(F.col("share"), "share"))


_RING = f"""{_B}, h1 as (select distinct batch_id, src id from b join dir on dst = id), r1 as (select batch_id, id, min(ring) ring from (select batch_id, id, 0 ring from b union all select batch_id, id, 1 from h1) group by 1, 2),
h2 as (select distinct batch_id, src id from (select * from r1 where ring = 1) q join dir on dst = q.id), r2 as (select batch_id, id, min(ring) ring from (select * from r1 union all select batch_id, id, 2 from h2) group by 1, 2)"""


@query(f"with {V_SQL}, {_RING} select batch_id, id, ring from r2")
def rings(spark, d):
    return gr.rings(edges(spark, d, "voronoi"), _read(spark, d, "batch_seeds"), "batch_id", "node_index")


@query(f"""with {V_SQL}, {_RING}, nodes as (select *, row_number() over (partition by batch_id order by ring, id) - 1 local_ix from r2)
select a.batch_id, s.local_ix as src_ix, a.local_ix as dst_ix, a.ring = 0 as leak from nodes a join dir on dst = a.id join nodes s on s.batch_id = a.batch_id and s.id = src where a.ring < 2""")
def tile_edges(spark, d):
    return mo.tile_batch(edges(spark, d, "voronoi"), _read(spark, d, "batch_seeds"), "batch_id", "node_index")[1]


@query(f"""with recursive {C_SQL}, p as (select sample_id s, cell_ix id, x_um x, y_um y from c where x_um is not null),
t as (select s, id, x, y, cast(1 as bigint) tile, count(*) over (partition by s) n, max(y) over (partition by s) - min(y) over (partition by s) > max(x) over (partition by s) - min(x) over (partition by s) tall from p
  union all select s, id, x, y, half, count(*) over (partition by s, half), max(y) over (partition by s, half) - min(y) over (partition by s, half) > max(x) over (partition by s, half) - min(x) over (partition by s, half)
  from (select *, tile * 2 + cast(k > n // 2 as int) half from (select *, row_number() over (partition by s, tile order by case when tall then y else x end, id) k from t where n > 100)))
select s as sample_id, id, tile from t where n <= 100""")
def spatial_tiles(spark, d):
    """Recursive median splits of each slide into tiles of at most 100 cells."""
    return ba.spatial_tiles(cells(spark, d).dropna(subset=["x_um", "y_um"]), "sample_id", "cell_ix", "x_um", "y_um", 100)


@query(f"""with {C_SQL}, z as (select *, floor(x_um / 200) tx, floor(y_um / 200) as ty from c where x_um is not null)
select cell_ix, sample_id, cast((cast(tx * 1009 + ty * 9176 + 1000000 as hugeint) * 2654435761) % 4294967296 as bigint) % 100 < 30 as is_test from z where x_um - tx * 200 > 10 and x_um - tx * 200 < 190 and y_um - ty * 200 > 10 and y_um - ty * 200 < 190""")
def spatial_split(spark, d):
    return ba.spatial_split(cells(spark, d).dropna(subset=["x_um", "y_um"]), "cell_ix", "sample_id", "x_um", "y_um", 200.0, 10.0, 30)


@query(f"with {T_SQL} select cell_ix, type from (select *, row_number() over (partition by type order by {_H.format('cell_ix')}, cell_ix) r, count(*) over (partition by type) n from t) where n >= 10 and r <= 100")
def stratified_sample(spark, d):
    return ba.stratified_sample(types(spark, d), "cell_ix", "type", 100)


# Model equations


@query(f"with {V_SQL}, {T_SQL}, {BETA_SQL} select dst, type as gene, round(sum(beta), 6) as influx from beta join t on cell_ix = src group by 1, 2")
def foreign_influx(spark, d):
    b = gr.smoothing_weights(edges(spark, d, "voronoi"), "shared_wall_um", "centroid_dist_um")
    return eq.foreign_influx(b, types(spark, d).withColumn("one", F.lit(1.0)), "cell_ix", "type", "one").withColumn("influx", F.round("influx", 6))


@query(f"""with {V_SQL}, {T_SQL}, {BETA_SQL}, p as (select cell_ix, type gene, 1.0::double own, 0.0::double far from t union all select dst, type, 0.0::double, sum(beta) from beta join t on cell_ix = src group by 1, 2),
m as (select cell_ix, gene, sum(own) * 0.8 + sum(far) * 0.2 mixed from p group by 1, 2) select cell_ix, gene, round(ln(greatest(mixed / greatest(sum(mixed) over (partition by cell_ix), 1e-8), 1e-8)), 6) as log_p from m""")
def leakage_mix(spark, d):
    t = types(spark, d).withColumn("one", F.lit(1.0))
    far = eq.foreign_influx(gr.smoothing_weights(edges(spark, d, "voronoi"), "shared_wall_um", "centroid_dist_um"), t, "cell_ix", "type", "one")
    both = t.select("cell_ix", F.col("type").alias("gene"), F.col("one").alias("own"), F.lit(0.0).alias("far")).unionByName(far.select(F.col("dst").alias("cell_ix"), "gene", F.lit(0.0).alias("own"), F.col("influx").alias("far")))
    rows = both.groupBy("cell_ix", "gene").agg(F.sum("own").alias("own"), F.sum("far").alias("far"))
    return rows.select("cell_ix", "gene", _r(eq.leakage_mix(F.col("own"), F.col("far"), 0.2, ["cell_ix"]), "log_p"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """cell, gene, n: brands as genes, orders as cells, quantities as counts."""
    li, p = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), _read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    return li.join(p, "l_partkey").groupBy((F.col("l_orderkey") % 500).alias("cell"), "gene").agg(F.sum("l_quantity").alias("n"))


_N = "n as (select l_orderkey % 500 as cell, p_brand gene, sum(l_quantity) n from lineitem join part on p_partkey = l_partkey group by 1, 2)"


@query(f"with {_N}, p as (select gene, sum(n) / (select sum(n) from n) p from n group by 1) select cell, round(sum(n.n * ln(greatest(p, 1e-8))) / greatest(sum(n.n), 1), 6) as loglik from n join p using (gene) group by 1")
def multinomial_loglik(spark, d):
    n = _counts(spark, d)
    p = n.groupBy("gene").agg(F.sum("n").alias("g")).crossJoin(F.broadcast(n.agg(F.sum("n").alias("a")))).select("gene", (F.col("g") / F.col("a")).alias("p"))
    return n.join(p, "gene").groupBy("cell").agg(_r(eq.multinomial_loglik("n", "p", True), "loglik"))


@query(f"with {_N} select cell, gene, round(ln(1 + n), 6) as x from n")
def log1p_counts(spark, d):
    return _counts(spark, d).select("cell", "gene", _r(F.log1p("n"), "x"))


_E = lambda k: f"cast(embedding[{k}] as double)"


@query("select vec_id, round(" + " + ".join(f"({_E(4 * k + 4)} - {_E(4 * k + 2)} + (exp({_E(4 * k + 2)}) + ({_E(4 * k + 1)} - {_E(4 * k + 3)}) * ({_E(4 * k + 1)} - {_E(4 * k + 3)})) / exp({_E(4 * k + 4)}) - 1) / 2" for k in range(8)) + ", 6) as kl from embeddings")
def gaussian_kl(spark, d):
    e = lambda k: F.col("embedding")[k].cast("double")
    total = sum((eq.gaussian_kl(e(4 * k), e(4 * k + 1), e(4 * k + 2), e(4 * k + 3)) for k in range(1, 8)), eq.gaussian_kl(e(0), e(1), e(2), e(3)))
    return _read(spark, d, "embeddings").select("vec_id", _r(total, "kl"))


@query(f"with {V_SQL}, s as (select dst, src, coalesce(shared_wall_um, 0) / 10 as z from dir), m as (select *, exp(z - max(z) over (partition by dst)) ez from s) select dst, src, round(ez / sum(ez) over (partition by dst), 6) as alpha from m")
def segment_softmax(spark, d):
    rows = gr.directed(edges(spark, d, "voronoi"), ["shared_wall_um"]).withColumn("score", F.coalesce("shared_wall_um", F.lit(0.0)) / 10)
    return rows.select("dst", "src", _r(gr.segment_softmax(["dst"], "score"), "alpha"))


@query(f"""with {V_SQL}, h as (select cell_ix, cell_ix % 7 / 7.0::double a, cell_ix % 11 / 11.0::double b from (select distinct cell_ix from cells)),
s as (select dst, src, x.a sa, x.b sb, case when x.a + y.b - 0.6 > 0 then x.a + y.b - 0.6 else 0.2 * (x.a + y.b - 0.6) end + case when x.b - y.a > 0 then x.b - y.a else 0.2 * (x.b - y.a) end z from dir join h x on x.cell_ix = src join h y on y.cell_ix = dst),
m as (select *, exp(z - max(z) over (partition by dst)) ez from s) select dst, round(sum(ez * sa) / sum(ez), 6) as a, round(sum(ez * sb) / sum(ez), 6) as b from m group by 1""")
def gat_aggregate(spark, d):
    h = _read(spark, d, "cells").select("cell_ix").distinct().select("cell_ix", (F.col("cell_ix") % 7 / 7.0).alias("a"), (F.col("cell_ix") % 11 / 11.0).alias("b"))
    side = lambda n, c: h.select(F.col("cell_ix").alias(n), F.col("a").alias(f"{c}a"), F.col("b").alias(f"{c}b"))
    leaky = lambda x: F.when(x > 0, x).otherwise(x * 0.2)
    rows = gr.directed(edges(spark, d, "voronoi"), []).join(side("src", "s"), "src").join(side("dst", "t"), "dst")
    rows = rows.select("dst", F.col("sa").alias("a"), F.col("sb").alias("b"), (leaky(F.col("sa") + F.col("tb") - 0.6) + leaky(F.col("sb") - F.col("ta"))).alias("score"))
    return mo.attention(rows, "score", ["a", "b"]).select("dst", _r(F.col("a"), "a"), _r(F.col("b"), "b"))


@query()
def simulate(spark, d):
    """A simulated tissue; tested by its invariants."""
    return mo.simulate(spark, 2000)[0].select("cell_ix", "type", "total", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))


# Vectors


_U = """m as (select k, avg(cast(embedding[k] as double)) mu from embeddings, range(1, 65) r(k) group by 1), l as (select vec_id, label, k, cast(embedding[k] as double) - mu c from embeddings, m),
u as (select vec_id, label, k, c / sqrt(sum(c * c) over (partition by vec_id)) x from l), s as (select a.vec_id i, b.vec_id j, a.label li, b.label lj, sum(a.x * b.x) sim from u a join u b on a.k = b.k and a.vec_id <> b.vec_id group by all)"""


@query(f"""with {_U}, top as (select i, li = arg_max(lj, (round(sim, 12), -j)) hit from s group by i, li)
select round((select avg(sim) from s where li = lj), 6) as mean_same, round((select avg(sim) from s where li <> lj), 6) as mean_other, round((select avg(cast(hit as int)) from top), 6) as agreement, round(1.0 / (select count(distinct label) from embeddings), 6) as chance, (select count(*) from embeddings) as n""")
def separation_report(spark, d):
    u = vq.centred_units(_read(spark, d, "embeddings"), "vec_id", "embedding", 64, ["label"])
    r = vq.separation_report(u, "vec_id", "label")
    return r.select(*(_r(F.col(c), c) for c in ("mean_same", "mean_other", "agreement", "chance")), "n")


@query("""with m as (select k, avg(cast(embedding[k] as double)) mu from embeddings, range(1, 65) r(k) group by 1), l as (select vec_id, k, cast(embedding[k] as double) - mu c from embeddings, m)
select vec_id, round(sqrt(sum(c * c)), 6) as centred_norm, round(sum(c * mu) / nullif(sqrt(sum(c * c)) * (select sqrt(sum(mu * mu)) from m), 0), 6) as cosine_to_mean from l join m using (k) group by 1""")
def centred_cosine(spark, d):
    e = _read(spark, d, "embeddings")
    mean = e.agg(F.array(*(F.avg(F.col("embedding")[k].cast("double")) for k in range(64))).alias("mu"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = e.crossJoin(F.broadcast(mean)).withColumn("c", F.zip_with("embedding", "mu", lambda a, b: a.cast("double") - b)).withColumn("n", F.sqrt(dot("c", "c")))
    return rows.select("vec_id", _r(F.col("n"), "centred_norm"), _r(dot("c", "mu") / F.nullif(F.col("n") * F.sqrt(dot("mu", "mu")), F.lit(0.0)), "cosine_to_mean"))


@query(f"""with {V_SQL}, {T_SQL}, {NICHE_SQL}, {COMP_SQL}, sc as (select dst, comp.type guess, sum(n.share * comp.share) score from n join comp on comp.neighbour_type = n.type group by 1, 2),
best as (select dst, guess, row_number() over (partition by dst order by round(score, 9) desc, guess) r from sc) select count(*) as n, round(avg(cast(guess = type as int)), 6) as accuracy from best join t on cell_ix = dst where r = 1""")
def composition_baseline(spark, d):
    """Accuracy of guessing a cell's type from its neighbours' types and the composition table."""
    t = types(spark, d)
    n = gr.niche(edges(spark, d, "voronoi"), t, "cell_ix", "type")
    table = gr.composition(n, t, "cell_ix", "type").select(F.col("type").alias("guess"), F.col("neighbour_type").alias("type"), F.col("share").alias("w"))
    score = n.join(table, "type").groupBy("dst", "guess").agg(F.round(F.sum(F.col("share") * F.col("w")), 9).alias("score"))
    best = score.groupBy("dst").agg(F.min_by("guess", F.struct(-F.col("score"), "guess")).alias("guess"))
    return best.join(t.withColumnRenamed("cell_ix", "dst"), "dst").agg(F.count(F.lit(1)).alias("n"), _r(F.avg((F.col("guess") == F.col("type")).cast("int")), "accuracy"))


@query("with s as (select cast(embedding[1] as double) s, label = 3 p from embeddings), r as (select p, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 k from s) select round((sum(k) filter (where p) - count(*) filter (where p) * (count(*) filter (where p) + 1) / 2.0) / (count(*) filter (where p) * count(*) filter (where not p)), 6) as auc from r")
def type_auc(spark, d):
    rows = _read(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("s"), (F.col("label") == 3).alias("p"))
    return vq.rank_auc(rows, "s", "p").select(_r(F.col("auc"), "auc"))


# Images


@query("select x, y, power((x - 127.5) * 0.5, 2) + power((y - 127.5) * 0.5, 2) > 625 as keep from range(256) a(x), range(256) b(y)")
def ego_disk(spark, d):
    import numpy as np

    y, x = np.mgrid[0:256, 0:256]
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "keep": disk_mask(256, 25.0, 128.0).ravel()}), "x bigint, y bigint, keep boolean")


@query("select sample_id, count(distinct cell_ix) as n_cells from cells where spatial_x >= 1000 and spatial_x < 2000 and spatial_y >= 1000 and spatial_y < 2000 and not isnan(spatial_x) and not isnan(spatial_y) group by 1")
def crop_membership(spark, d):
    c = _read(spark, d, "cells").filter(usable("spatial_x", "spatial_y")).filter(im.in_window("spatial_x", "spatial_y", 1000, 1000, 2000, 2000))
    return c.groupBy("sample_id").agg(F.count_distinct("cell_ix").alias("n_cells"))


@query("select 4 as level, 16 as factor")
def level_selection(spark, d):
    levels = spark.range(8).select(F.col("id").cast("int").alias("level"), F.pow(F.lit(2), "id").cast("int").alias("factor"))
    return im.finest_level(levels, 150_000, 12_000)


# Streams in batch form


@query("select time_bucket(interval '6 hours', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark, d):
    return tumbling(_read(spark, d, "events"), "ts", "6 hours", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) g from o)
select min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, user_id, count(*) as n from s group by user_id, g""")
def event_sessions(spark, d):
    return sessions(_read(spark, d, "events"), "ts", "30 minutes", "1 day", ["user_id"])

