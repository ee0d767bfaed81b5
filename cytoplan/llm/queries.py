"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text_keys import id_key
from ..operators.proximity import usable
from ..queries import read
from .clustering import against_labels, density_groups, typical_members
from .cooccurrence import association, edge_label_pairs, pair_counts
from .languages import document_languages, fit, label_problems, language_segments
from .leakage import is_leak, leaked_items
from .mixing import mix, short_sources, token_counts
from .quantiles import combine, is_measurement, percentiles
from .splits import connected_sets, pairs_within, stratified_splits, ties_by_key, ties_by_place
from .vectors import exact_nearest, nearest, usable_vectors

# Problem 1

PERCENTS = [1, 5, 25, 50, 75, 95, 99]
METRICS = ("shared_wall_um", "centroid_dist_um")


def _measurements(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    """kind (lower case, without blanks), the columns in by, metric, value: the measurements of both metrics in long form."""
    e = read(spark, d, "cell_edges").select(F.lower(F.trim("kind")).alias("kind"), *by, *METRICS)
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.when(is_measurement(m), F.col(m)).alias("value")) for m in METRICS)))
    return e.select("kind", *by, pairs.alias("x")).select("kind", *by, "x.metric", "x.value").filter("value is not null")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_measurements(spark, d, ["run_day"]), ["kind", "run_day", "metric"], "value", PERCENTS)


def p1_percentiles_by_slide(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_measurements(spark, d, ["run_day", "sample_id"]), ["kind", "run_day", "sample_id", "metric"], "value", PERCENTS)


def p1_percentiles_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_measurements(spark, d, []), ["kind", "metric"], "value", PERCENTS)


def p1_combined_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles of each kind from the summaries of its days, with the bound of their error in ranks."""
    days = percentiles(_measurements(spark, d, ["run_day"]), ["kind", "run_day", "metric"], "value", list(range(0, 101, 2)))
    return combine(days, ["kind", "metric"], PERCENTS)


def _percentiles_sql(by: str) -> str:
    ranks = ", ".join(f"({p})" for p in PERCENTS)
    cols = by + ", " if by else ""
    return f"""with m as (select lower(trim(kind)) kind, {cols} metric, value from (
  select kind, {cols} 'shared_wall_um' metric, shared_wall_um value from cell_edges union all select kind, {cols} 'centroid_dist_um', centroid_dist_um from cell_edges)
  where value is not null and not isnan(value) and not isinf(value) and value >= 0),
r as (select *, row_number() over (partition by kind, {cols} metric order by value) k, count(*) over (partition by kind, {cols} metric) n from m)
select kind, {cols} metric, n, p as percent, value from r, (values {ranks}) t(p) where k = greatest(1, (n * p + 99) // 100)"""


def _combined_sql() -> str:
    ranks = ", ".join(f"({p})" for p in PERCENTS)
    return f"""with m as (select lower(trim(kind)) kind, run_day, metric, value from (
  select kind, run_day, 'shared_wall_um' metric, shared_wall_um value from cell_edges union all select kind, run_day, 'centroid_dist_um', centroid_dist_um from cell_edges)
  where value is not null and not isnan(value) and not isinf(value) and value >= 0),
r as (select *, row_number() over (partition by kind, run_day, metric order by value) k, count(*) over (partition by kind, run_day, metric) n from m),
days as (select kind, run_day, metric, n, p, value from r, (select 2 * range p from range(51)) t where k = greatest(1, (n * p + 99) // 100)),
totals as (select kind, metric, sum(n) n, count(*) parts from days where p = 100 group by 1, 2),
steps as (select kind, metric, value, sum(cast(n as double)) w from days where p > 0 group by 1, 2, 3),
run as (select *, sum(w) over (partition by kind, metric order by value) / 50 c from steps)
select run.kind, run.metric, cast(totals.n as bigint) n, cast(1 as double) / 50 + cast(parts as double) / totals.n as rank_error, q.percent, min(value) as value
from run join totals on run.kind is not distinct from totals.kind and run.metric = totals.metric, (values {ranks}) q(percent) where c >= totals.n * q.percent / 100.0 - 1e-6 group by 1, 2, 3, 4, 5"""


# Problem 3


def _seed_vectors(spark: SparkSession, d: str) -> DataFrame:
    return usable_vectors(read(spark, d, "batch_seeds"), "node_id", "image_embedding", "found", ["loaded_at", "seed_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(_seed_vectors(spark, d), 5, least=0.9)
    a, b = near.select(F.col("id").alias("node_a"), F.col("other").alias("node_b")), near.select(F.col("other").alias("node_a"), F.col("id").alias("node_b"))
    return a.intersect(b).filter("node_a < node_b")


def p3_most_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar cells of every cell whose node_index is divisible by 50, against all cells."""
    ids = read(spark, d, "batch_seeds").filter("node_index % 50 = 0").select(F.col("node_id").alias("id")).distinct()
    return nearest(_seed_vectors(spark, d), 5, queries=ids)


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many cells p3_most_similar asks for, and whether it finds nine of ten of the most similar ones that comparing with all gives."""
    ids = read(spark, d, "batch_seeds").filter("node_index % 50 = 0").select(F.col("node_id").alias("id")).distinct()
    want = exact_nearest(_seed_vectors(spark, d), 5, ids).select("id", "other")
    got = p3_most_similar(spark, d).select("id", "other", F.lit(1).alias("hit"))
    both = want.join(got, ["id", "other"], "left")
    return both.agg(F.count_distinct("id").alias("asked"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


# Problem 7


def latest_labels(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, cell_key, label: the last loaded row's label of each cell (ties: the higher row_id); null and Unassigned are no label."""
    rows = read(spark, d, "cell_groups").select("sample_id", id_key("cell_id").alias("cell_key"), F.lower(F.trim("group_name")).alias("label"), "loaded_at", "row_id").dropna(subset=["sample_id", "cell_key"])
    last = rows.groupBy("sample_id", "cell_key").agg(F.max_by("label", F.struct("loaded_at", "row_id")).alias("label"))
    return last.filter("label is not null and label <> 'unassigned'")


def _voronoi_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "cell_edges").filter(F.lower(F.trim("kind")) == "voronoi").dropna(subset=["i", "j"])
    up = F.col("i") <= F.col("j")
    e = e.select("sample_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(up, id_key("cell_i")).otherwise(id_key("cell_j")).alias("cell_i"), F.when(up, id_key("cell_j")).otherwise(id_key("cell_i")).alias("cell_j"))
    return e.groupBy("i", "j").agg(*(F.min(c).alias(c) for c in ("sample_id", "cell_i", "cell_j")))


def _label_lifts(spark: SparkSession, d: str) -> DataFrame:
    from ..runtime import cut

    met = cut(edge_label_pairs(_voronoi_pairs(spark, d), latest_labels(spark, d), ("sample_id", "cell_i"), ("sample_id", "cell_j"), ("sample_id", "cell_key"), "label"))
    ends = met.select(F.col("label_a").alias("item"), "n").unionByName(met.select(F.col("label_b").alias("item"), "n")).groupBy("item").agg(F.sum("n").alias("n"))
    total = met.agg((2 * F.sum("n")).cast("double").alias("total"))
    return association(met.select(F.col("label_a").alias("item_a"), F.col("label_b").alias("item_b"), F.col("n").alias("n_both")), ends, total)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _label_lifts(spark, d).filter("item_a < item_b and n_both >= 15 and lift >= 2").select(F.col("item_a").alias("group_a"), F.col("item_b").alias("group_b"))


def p7_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = _label_lifts(spark, d)
    return out.select(F.col("item_a").alias("group_a"), F.col("item_b").alias("group_b"), F.col("n_both").alias("n_edges"), F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p7_labels_on_a_slide(spark: SparkSession, d: str) -> DataFrame:
    """Labels that occur on the same slide: pairs over slides as baskets, of any size."""
    rows = latest_labels(spark, d).select("sample_id", "label").distinct()
    pairs = pair_counts(rows, "sample_id", "label")
    singles = rows.groupBy(F.col("label").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count_distinct("sample_id").cast("double").alias("total"))
    return association(pairs, singles, total).select(F.col("item_a").alias("group_a"), F.col("item_b").alias("group_b"), F.col("n_both").alias("n_slides"), F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


_LABELS_SQL = """
labels as (select sample_id, k, l from (select sample_id, lower(trim(cell_id)) k, lower(trim(group_name)) l, row_number() over (partition by sample_id, lower(trim(cell_id)) order by loaded_at desc, row_id desc) r
  from cell_groups where cell_id is not null and sample_id is not null) where r = 1 and l is not null and l <> 'unassigned')"""
_MET_SQL = f"""with {_LABELS_SQL},
e as (select least(i, j) i, greatest(i, j) j, min(sample_id) s, min(lower(trim(case when i <= j then cell_i else cell_j end))) ci, min(lower(trim(case when i <= j then cell_j else cell_i end))) cj
  from cell_edges where lower(trim(kind)) = 'voronoi' group by 1, 2),
met as (select least(a.l, b.l) group_a, greatest(a.l, b.l) group_b, count(*) n from e join labels a on a.sample_id = s and a.k = ci join labels b on b.sample_id = s and b.k = cj group by 1, 2),
ends as (select l, sum(n) n from (select group_a l, n from met union all select group_b, n from met) group by 1),
lifts as (select group_a, group_b, met.n n_edges, cast(met.n as double) * (select cast(2 * sum(n) as double) from met) / (cast(x.n as double) * y.n) lift from met join ends x on x.l = group_a join ends y on y.l = group_b)
"""

# Problem 9


def _sized_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.translate(F.lower(F.trim("source")), "-", "_").alias("source"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), "text")
    return token_counts(docs, "text").withColumn("copy_key", F.concat_ws(":", "h1", "h2")).drop("h1", "h2")


def _mix_targets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "mix_targets").select("source", "target_share", "max_repeats")


def _mix(spark: SparkSession, d: str, overlap: bool) -> tuple[DataFrame, DataFrame]:
    from ..runtime import cut

    return mix(cut(_sized_documents(spark, d)), _mix_targets(spark, d), "doc_id", "copy_key", "source", "n_tokens", overlap=overlap)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return short_sources(_mix(spark, d, False)[1])


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, True)[0].select("doc_id", "source", "uses")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, True)[1]


# Problem 4


def _slide_sets(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "cells").select("sample_id", id_key("cell_id").alias("cell_key"), "cell_ix", "spatial_x", "spatial_y", "microns_per_pixel")
    placed = cells.filter(usable("spatial_x", "spatial_y")).select("sample_id", "cell_ix", (F.col("spatial_x") * F.col("microns_per_pixel")).alias("x"), (F.col("spatial_y") * F.col("microns_per_pixel")).alias("y")).distinct()
    return connected_sets([ties_by_key(cells, "sample_id", "cell_key", 10), ties_by_place(placed, "sample_id", "x", "y", 0.1, 10)])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(_slide_sets(spark, d)).select(F.col("a").alias("sample_a"), F.col("b").alias("sample_b"))


SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _cells_with_labels(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "cells").select("sample_id", id_key("cell_id").alias("cell_key")).distinct()
    return cells.join(latest_labels(spark, d), ["sample_id", "cell_key"], "left")


def p4_slide_splits(spark: SparkSession, d: str) -> DataFrame:
    from ..runtime import cut

    return stratified_splits(cut(_cells_with_labels(spark, d)), "sample_id", "label", _slide_sets(spark, d), SPLITS)


def p4_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Cells and cell_groups rows per split and label."""
    slides = p4_slide_splits(spark, d).select("sample_id", "split")
    cells = _cells_with_labels(spark, d).join(slides, "sample_id").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_cells"), F.lit(0).cast("bigint").alias("n_rows"))
    label = F.lower(F.trim("group_name"))
    groups = read(spark, d, "cell_groups").select("sample_id", F.when(label != "unassigned", label).alias("label")).join(slides, "sample_id").groupBy("split", "label").agg(F.lit(0).cast("bigint").alias("n_cells"), F.count(F.lit(1)).alias("n_rows"))
    return cells.unionByName(groups).groupBy("split", "label").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_rows").alias("n_rows"))


_TIES_SQL = """
with recursive k as (select distinct sample_id s, lower(trim(cell_id)) k from cells),
p as (select distinct sample_id s, cell_ix, spatial_x * microns_per_pixel x, spatial_y * microns_per_pixel y from cells
  where spatial_x is not null and spatial_y is not null and not isnan(spatial_x) and not isnan(spatial_y) and not (spatial_x = 0 and spatial_y = 0)),
q as (select *, cast(floor(x / 0.1) as bigint) gx, cast(floor(y / 0.1) as bigint) gy from p),
n as (select a.s a, b.s b, a.cell_ix ca, b.cell_ix cb from (select *, gx + dx hx, gy + dy hy from q, (values (-1), (0), (1)) t(dx), (values (-1), (0), (1)) u(dy)) a join q b on a.hx = b.gx and a.hy = b.gy and a.s < b.s
  where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.1),
tie as (select a.s a, b.s b from k a join k b on a.k = b.k and a.s < b.s group by 1, 2 having count(*) >= 10
  union select a, b from n group by 1, 2 having greatest(count(distinct ca), count(distinct cb)) >= 10),
both_ways as (select a, b from tie union select b, a from tie),
reach as (select a, b from both_ways union select r.a, t.b from reach r join both_ways t on r.b = t.a)
select distinct a as sample_a, b as sample_b from reach where a < b"""

# Problem 5


def _seed_groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return density_groups(usable_vectors(read(spark, d, "batch_seeds"), "node_id", "image_embedding", "found", ["loaded_at", "seed_id"], ["sample_id"]))


def _seed_labels(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    """members with the graphclust number of the last row loaded for the cell (ties: the higher row_id); null if none is known."""
    rows = read(spark, d, "clusters").filter(F.lower(F.trim("clustering")) == "graphclust").select("sample_id", id_key("barcode").alias("cell_key"), "cluster_no", "loaded_at", "row_id")
    last = rows.groupBy("sample_id", "cell_key").agg(F.max_by("cluster_no", F.struct("loaded_at", "row_id")).alias("cluster_no"))
    return members.withColumn("cell_key", id_key("id")).join(last, ["sample_id", "cell_key"], "left").drop("cell_key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from ..runtime import cut

    members = _seed_groups(spark, d)[0].filter("group_id is not null").select("id", "group_id", "sample_id")
    held = against_labels(cut(_seed_labels(spark, d, members)), "cluster_no")
    return held.filter("label <> usual").select(F.col("id").alias("node_id")).distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group with its size, tightness, five most typical cells, and the graphclust number most of them have with its share."""
    from ..runtime import cut

    members, groups = _seed_groups(spark, d)
    held = against_labels(cut(_seed_labels(spark, d, members.select("id", "group_id", "sample_id"))), "cluster_no")
    purity = held.groupBy("group_id").agg(F.first("usual").alias("cluster_no"), F.avg((F.col("label") == F.col("usual")).cast("double")).alias("share"))
    best = typical_members(members, 5).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("t"))
    return groups.join(purity, "group_id", "left").join(best, "group_id").select("group_id", "n", F.round("tightness", 6).alias("tightness"), "cluster_no", F.round("share", 6).alias("share"), F.col("t.id").alias("typical"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    return _seed_groups(spark, d)[0].select(F.col("id").alias("node_id"), "sample_id", "group_id", F.round("similarity", 6).alias("similarity"))


# Problem 8


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The best aligned stretch of every candidate document and item, leak or not."""
    return leaked_items(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stretches(spark, d).filter(is_leak()).select("doc_id", "item_id").distinct()


# Problem 10


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The segments of all documents, and the languages that labels name beside those with known spellings."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    model = fit(docs, "doc_id", "text", "lang")
    return language_segments(docs, "doc_id", "text", model), model.further if model else []


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    segments, further = _segments(spark, d)
    return label_problems(read(spark, d, "documents").select("doc_id", "lang"), document_languages(segments, "doc_id"), "doc_id", "lang", further)


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(_segments(spark, d)[0], "doc_id")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)[0]


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_percentiles_by_slide": p1_percentiles_by_slide,
    "p1_percentiles_by_kind": p1_percentiles_by_kind,
    "p1_combined_by_kind": p1_combined_by_kind,
    "p3_found": p3_found,
    "p3_most_similar": p3_most_similar,
    "p3_recall": p3_recall,
    "p4_found": p4_found,
    "p4_slide_splits": p4_slide_splits,
    "p4_split_report": p4_split_report,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_members": p5_members,
    "p7_found": p7_found,
    "p7_label_pairs": p7_label_pairs,
    "p7_labels_on_a_slide": p7_labels_on_a_slide,
    "p8_found": p8_found,
    "p8_stretches": p8_stretches,
    "p9_found": p9_found,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_languages": p10_languages,
    "p10_segments": p10_segments,
}

SQL = {
    "p1_percentiles": _percentiles_sql("run_day"),
    "p1_percentiles_by_slide": _percentiles_sql("run_day, sample_id"),
    "p1_percentiles_by_kind": _percentiles_sql(""),
    "p1_combined_by_kind": _combined_sql(),
    "p3_recall": """select count(distinct node_id) as asked, true as recall_reached from batch_seeds where node_index % 50 = 0 and node_id is not null and coalesce(found, true) and image_embedding is not null and len(image_embedding) = 64
  and len(list_filter(image_embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(image_embedding, lambda x: x <> 0)) > 0""",
    "p4_found": _TIES_SQL,
    # Any tokenizer gives the same cases; SQL has none, so characters stand for tokens.
    "p9_found": """with t as (select replace(lower(trim(source)), '-', '_') s, length(text) n from documents)
select m.source from mix_targets m left join (select s, sum(n) n from t group by 1) x on x.s = m.source where coalesce(x.n, 0) * m.max_repeats < m.target_share * (select sum(n) from t)""",
    "p7_found": _MET_SQL + "select group_a, group_b from lifts where group_a < group_b and n_edges >= 15 and lift >= 2",
    "p7_label_pairs": _MET_SQL + "select group_a, group_b, n_edges, round(lift, 6) as lift, round(ln(lift), 6) as pmi from lifts",
    "p7_labels_on_a_slide": f"""with {_LABELS_SQL}, b as (select distinct sample_id s, l from labels), one as (select l, count(*) n from b group by 1),
lifts as (select x.l group_a, y.l group_b, count(*) n_slides, cast(count(*) as double) * (select count(distinct s) from b) / (cast(any_value(p.n) as double) * any_value(q.n)) lift
  from b x join b y on x.s = y.s and x.l < y.l join one p on p.l = x.l join one q on q.l = y.l group by 1, 2)
select group_a, group_b, n_slides, round(lift, 6) as lift, round(ln(lift), 6) as pmi from lifts""",
}
