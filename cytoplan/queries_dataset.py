"""Queries of datasets, batches, graph variants, scoring and reports over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import batching as ba
from .operators import graph as gr
from .operators import scoring as sc
from .plans.dataset import CellGraph, check_halo, numbered_edges
from .queries_graph import BETA_SQL, C_SQL, COMP_SQL, E_SQL, NICHE_SQL, T_SQL, V_SQL, _H, _r, _read, cells, edges, outlines, types

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, d: str, images: str = "seeds") -> CellGraph:
    """The Voronoi graph of all slides as a served dataset; vectors are each cell's last usable delivery in batch_seeds."""
    table = cells(spark, d).select("cell_ix", "sample_id", "x_um", "y_um").join(types(spark, d), "cell_ix")
    good = _read(spark, d, "batch_seeds").filter("node_index is not null and image_embedding is not null and size(image_embedding) = 64 and coalesce(found, true)")
    last = good.groupBy(F.col("node_index").alias("cell_ix")).agg(F.max_by("image_embedding", F.struct("loaded_at", "seed_id")).alias("image_embedding"))
    return CellGraph(table, edges(spark, d, "voronoi"), last, 64, images)


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "batch_seeds").select("batch_id", F.col("node_index").alias("cell_ix"), "seed_index")


_SEEDS = "b as (select batch_id, node_index id, min(seed_index) seed_index from batch_seeds where batch_id is not null and node_index in (select cell_ix from cells) group by 1, 2)"
_NODES = "nd as (select batch_id, id, max(s) = 1 is_seed, row_number() over (partition by batch_id order by id) - 1 local_ix from (select batch_id, id, 1 s from b union all select batch_id, src, 0 from b join dir on dst = id) group by 1, 2)"
_IMAGED = "im as (select distinct node_index id from batch_seeds where node_index is not null and image_embedding is not null and len(image_embedding) = 64 and coalesce(found, true))"


@query(f"""with {V_SQL}, {T_SQL}, {_SEEDS}, {_NODES}, {_IMAGED} select nd.batch_id, local_ix, nd.id as cell_ix, is_seed, round(x_um, 6) as x_um, round(y_um, 6) as y_um, t.type, im.id is not null as found
from nd join c on c.cell_ix = nd.id join t on t.cell_ix = nd.id left join im on im.id = nd.id""")
def dataset_nodes(spark, d):
    n = graph(spark, d, "nodes").batch_from_seeds(seeds(spark, d)).nodes
    return n.select("batch_id", "local_ix", "cell_ix", "is_seed", _r(F.col("x_um"), "x_um"), _r(F.col("y_um"), "y_um"), "type", "found")


@query(f"""with {V_SQL}, {BETA_SQL}, {_SEEDS}, {_NODES}, ids as (select i, j, row_number() over (order by i, j) - 1 edge_id from v)
select b.batch_id, s.local_ix as src_ix, t.local_ix as dst_ix, edge_id, round(dir.centroid_dist_um, 6) as centroid_dist_um, round(beta, 6) as beta
from b join dir on dir.dst = b.id join beta on beta.dst = dir.dst and beta.src = dir.src join ids on ids.i = least(dir.dst, dir.src) and ids.j = greatest(dir.dst, dir.src)
join nd s on s.batch_id = b.batch_id and s.id = dir.src join nd t on t.batch_id = b.batch_id and t.id = dir.dst""")
def dataset_edges(spark, d):
    e = graph(spark, d).batch_from_seeds(seeds(spark, d)).edges
    return e.select("batch_id", "src_ix", "dst_ix", "edge_id", _r(F.col("centroid_dist_um"), "centroid_dist_um"), _r(F.col("beta"), "beta"))


@query(f"""with {V_SQL}, {T_SQL}, {_SEEDS}, {_NODES}, {_IMAGED} select b.batch_id, b.seed_index, local_ix, b.id as cell_ix, t.type, im.id is not null as found
from b join nd on nd.batch_id = b.batch_id and nd.id = b.id join t on t.cell_ix = b.id left join im on im.id = b.id""")
def dataset_seeds(spark, d):
    return graph(spark, d).batch_from_seeds(seeds(spark, d)).seeds.drop("image_embedding")


@query("""with n as (select count(distinct cell_ix) n from cells) select 64 as size, cast(ceil(n / 64.0) as bigint) as length, cast(ceil(n / 64.0) as bigint) as batches, n // 64 as whole_batches from n""")
def dataset_length(spark, d):
    """The length of an epoch, and the batches it has with and without a short last one."""
    g = graph(spark, d)
    count = lambda drop: ba.epoch_batches(g.cells, "cell_ix", 64, drop_last=drop).agg(F.count_distinct("batch_id").alias("n")).collect()[0]["n"]
    return spark.createDataFrame([(64, g.length(64), count(False), count(True))], "size int, length bigint, batches bigint, whole_batches bigint")


@query("select batch_id, cell_ix from (select cell_ix, (row_number() over (order by " + _H.format("cell_ix + 5") + ", cell_ix) - 1) // 50 batch_id from (select distinct cell_ix from cells)) where batch_id < (select count(distinct cell_ix) // 50 from cells)")
def whole_batches(spark, d):
    """Batches of 50 in another epoch's order, without the short last one."""
    return ba.epoch_batches(_read(spark, d, "cells"), "cell_ix", 50, seed=5, drop_last=True).select("batch_id", "cell_ix")


@query(f"with {V_SQL} select i, j, row_number() over (order by i, j) - 1 as edge_id from v")
def edge_ids(spark, d):
    return numbered_edges(edges(spark, d, "voronoi")).select("i", "j", "edge_id")


@query("select cast(null as bigint) as tile, cast(null as bigint) as n where false")
def halo_check(spark, d):
    """Edges of two-ring tiles whose source is outside the tile; there are none."""
    g = graph(spark, d)
    nodes, into = g.tiles(seeds(spark, d).dropna(subset=["batch_id", "cell_ix"]), "batch_id")
    return check_halo(nodes, into)


_PRUNED = f"{E_SQL}, v as (select * from e where kind = 'voronoi' and centroid_dist_um <= 40), dir as (select j dst, i src, true into_j, * from v union all select i, j, false, * from v)"


@query(f"with {_PRUNED}, {T_SQL}, {NICHE_SQL}, {COMP_SQL} select type, neighbour_type, round(share, 6) as share, support from comp")
def model_composition(spark, d):
    """Mean niches of types on the pruned graph."""
    kept, _ = gr.prune(edges(spark, d, "voronoi"), "centroid_dist_um")
    t = types(spark, d)
    return gr.composition(gr.niche(kept, t, "cell_ix", "type"), t, "cell_ix", "type").withColumn("share", F.round("share", 6))


@query(f"with {_PRUNED}, {T_SQL}, {NICHE_SQL} select dst, type, round(share, 6) as share from n")
def model_niche(spark, d):
    kept, _ = gr.prune(edges(spark, d, "voronoi"), "centroid_dist_um")
    return gr.niche(kept, types(spark, d), "cell_ix", "type").withColumn("share", F.round("share", 6))


@query(f"""with {E_SQL}, a as (select * from e where kind = 'voronoi'), ends as (select i x, centroid_dist_um d from a union all select j, d from (select j, centroid_dist_um d from a)),
deg as (select cell_ix, count(x) n from (select distinct cell_ix from cells) left join (select x from ends where d <= 40) on x = cell_ix group by 1), lost as (select x, count(*) n from ends where d is null or d > 40 group by 1)
select count(*) filter (where n = 0) as n_isolated, count(*) filter (where n = 1) as n_single, (select coalesce(max(n), 0) from lost) as most_lost from deg""")
def isolated_counts(spark, d):
    kept, lost = gr.prune(edges(spark, d, "voronoi"), "centroid_dist_um")
    return gr.isolation_counts(_read(spark, d, "cells"), "cell_ix", kept, lost)


@query(f"""with {E_SQL}, g as (select 'contact' graph, * from e where kind = 'contact' union all select 'contact_exact', * from e where kind = 'contact' and wall_dist_um = 0 union all select 'voronoi', * from e where kind = 'voronoi'),
k as (select distinct graph from g), ends as (select graph, i x from g union all select graph, j from g), deg as (select k.graph, c.cell_ix, count(x) n from k cross join (select distinct cell_ix from cells) c left join ends on ends.graph = k.graph and x = c.cell_ix group by all)
select d.graph, (select count(*) from g where g.graph = d.graph) as n_edges, round(avg(n), 6) as mean_degree, cast(floor(median(n)) as int) as median_degree, round(avg(cast(n = 0 as int)) * 100, 6) as isolated_percent,
(select round(median(centroid_dist_um), 6) from g where g.graph = d.graph) as median_centroid_um, (select round(median(wall_dist_um), 6) from g where g.graph = d.graph) as median_gap_um,
(select round(avg(cast(coalesce(wall_dist_um = 0, false) as int)) * 100, 6) from g where g.graph = d.graph) as touching_percent from deg d group by d.graph""")
def graph_statistics(spark, d):
    e = edges(spark, d)
    contact = e.filter("kind = 'contact'")
    variants = gr.graph_variants({"contact": contact, "contact_exact": contact.filter("wall_dist_um = 0"), "voronoi": e.filter("kind = 'voronoi'")})
    names = [r[0] for r in variants.select("graph").distinct().collect()]
    degree = gr.graph_variants({k: gr.degrees(_read(spark, d, "cells"), "cell_ix", variants.filter(F.col("graph") == k)) for k in names})
    out = gr.graph_statistics(degree, variants, "graph")
    return out.select("graph", "n_edges", "median_degree", *(_r(c, c) for c in ("mean_degree", "isolated_percent", "median_centroid_um", "median_gap_um", "touching_percent")))


@query(f"""with {V_SQL}, {T_SQL}, {_SEEDS}, h as (select b.batch_id, b.id, n.type, count(*) / cast(sum(count(*)) over (partition by b.batch_id, b.id) as double) share from b join dir on dst = b.id join t n on n.cell_ix = src group by 1, 2, 3),
s as (select distinct batch_id, id from h), k as (select o.type, count(*) c from s join t o on o.cell_ix = id group by 1) select o.type, h.type as neighbour_type, round(sum(share) / max(k.c), 6) as share from h join t o on o.cell_ix = h.id join k on k.type = o.type group by 1, 2""")
def batch_histogram(spark, d):
    """The neighbours' types that batches really show, averaged over the seeds of a type."""
    t = types(spark, d)
    one = seeds(spark, d).select("batch_id", F.col("cell_ix").alias("id")).dropna().distinct()
    beside = ba.batch_edges(one, "batch_id", "id", edges(spark, d, "voronoi")).join(t.select(F.col("cell_ix").alias("src"), F.col("type").alias("neighbour_type")), "src")
    counts = beside.groupBy("batch_id", "dst", "neighbour_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("batch_id", "dst").agg(F.sum("n").alias("all"))
    own = counts.join(total, ["batch_id", "dst"]).join(t.withColumnRenamed("cell_ix", "dst"), "dst")
    k = total.join(t.withColumnRenamed("cell_ix", "dst"), "dst").groupBy("type").agg(F.count(F.lit(1)).alias("k"))
    return own.groupBy("type", "neighbour_type").agg(F.sum(F.col("n") / F.col("all")).alias("s")).join(k, "type").select("type", "neighbour_type", _r(F.col("s") / F.col("k"), "share"))


@query(f"with {T_SQL}, k as (select type, count(*) c from t group by 1) select arg_min(type, (-c, type)) as label, round(max(c) / sum(c), 6) as rate, cast(sum(c) as bigint) as n from k")
def majority_rate(spark, d):
    return sc.majority_rate(types(spark, d), "type").select("label", _r(F.col("rate"), "rate"), "n")


@query("""with s as (select k, cast(embedding[k + 1] as double) s, label = k p from embeddings, range(10) r(k)), r as (select k, p, rank() over (partition by k order by s) + (count(*) over (partition by k, s) - 1) / 2.0 x from s),
a as (select k, (sum(x) filter (where p) - count(*) filter (where p) * (count(*) filter (where p) + 1) / 2.0) / (count(*) filter (where p) * count(*) filter (where not p)) auc from r group by 1) select round(avg(auc), 6) as auc, count(auc) as n_classes from a""")
def macro_auc(spark, d):
    """Each class of embeddings scored by one entry of the vector; the mean over all classes."""
    rows = _read(spark, d, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 10)).alias("k", "score")).withColumn("positive", F.col("label") == F.col("k"))
    return sc.macro_auc(rows, "k", "score", "positive").select(_r(F.col("auc"), "auc"), "n_classes")


@query()
def logistic_scores(spark, d):
    """Labels of embeddings from their vectors by a multinomial logistic model; tested on vectors that tell their labels."""
    rows = _read(spark, d, "embeddings")
    test = F.pmod(ba.shuffle_key("vec_id"), F.lit(100)) < 30
    return sc.logistic_scores(rows.filter(~test), rows.filter(test), "vec_id", "embedding", "label")


@query(f"with {C_SQL} select cell_ix from c where x_um is not null and area_um2 is not null and sqrt(area_um2 / (2 * sqrt(2.0))) <= 5")
def selectable(spark, d):
    """Cells (as octagons of their area) that a disc of 5 µm covers."""
    return outlines(spark, d).filter(F.col("r") <= 5.0).select("cell_ix")


@query(f"""with {C_SQL}, o as (select cell_ix, sqrt(area_um2 / (2 * sqrt(2.0))) r from c where x_um is not null and area_um2 is not null), n as (select *, row_number() over (order by r, cell_ix) k, count(*) over () n from o)
select 'smallest' as pick, cell_ix, round(r, 6) as r from n where k = 1 union all select 'largest', cell_ix, round(r, 6) from n where k = n
union all select 'median', cell_ix, round(r, 6) from n where k = (n - 1) // 2 + 1 union all (select 'largest_fitting', cell_ix, round(r, 6) from n where r <= 5 order by r desc, cell_ix desc limit 1)""")
def size_picks(spark, d):
    return sc.size_picks(outlines(spark, d), "cell_ix", "r", 5.0).select("pick", "cell_ix", _r(F.col("r"), "r"))


@query(f"with {T_SQL} select type, count(*) as n, row_number() over (order by length(type), type) as natural_place, row_number() over (order by count(*) desc, type) as count_place from t group by type")
def label_order(spark, d):
    """Labels in their natural order (by length, then text) and by falling count."""
    from pyspark.sql import Window

    place = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("bigint")  # noqa: E731  # labels are few
    counts = types(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("type", "n", place(F.length("type"), "type").alias("natural_place"), place(F.desc("n"), "type").alias("count_place"))


@query(f"with {V_SQL}, {T_SQL}, {NICHE_SQL}, {COMP_SQL}, s as (select type, max(support) support from comp group by 1) select type, support from s order by support desc, type limit 5")
def top_types(spark, d):
    """The five types with most connected cells."""
    t = types(spark, d)
    table = gr.composition(gr.niche(edges(spark, d, "voronoi"), t, "cell_ix", "type"), t, "cell_ix", "type")
    return table.groupBy("type").agg(F.max("support").alias("support")).orderBy(F.desc("support"), "type").limit(5)


@query(f"with {T_SQL}, k as (select *, row_number() over (partition by type order by {_H.format('cell_ix')}, cell_ix) r, (select count(distinct type) from t) m from t) select cell_ix, type from k where r <= greatest(1, 600 // m)")
def balanced_sample(spark, d):
    """Six hundred cells spread evenly over the types."""
    t = types(spark, d)
    return ba.stratified_sample(t, "cell_ix", "type", max(1, 600 // t.select("type").distinct().count()), least=1).select("cell_ix", "type")


@query(f"select cell_ix from (select distinct cell_ix from cells) order by {_H.format('cell_ix')}, cell_ix limit 500")
def hash_subset(spark, d):
    """Five hundred cells, the same at any time."""
    return _read(spark, d, "cells").select("cell_ix").distinct().orderBy(ba.shuffle_key("cell_ix"), "cell_ix").limit(500)


@query("select cast(null as bigint) as batch_id, cast(null as bigint) as id where false")
def ring_overlap(spark, d):
    """Cells in two rings of one batch: the rings are disjoint, so none."""
    r = gr.rings(edges(spark, d, "voronoi"), _read(spark, d, "batch_seeds"), "batch_id", "node_index")
    part = lambda k: r.filter(F.col("ring") == k).select("batch_id", "id")
    return part(0).intersect(part(1)).union(part(0).intersect(part(2))).union(part(1).intersect(part(2)))
