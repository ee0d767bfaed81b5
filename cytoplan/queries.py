"""Queries of the core: the driver's tables in, DataFrames out, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_dataset as data
from . import queries_graph as graph
from .functions.text_keys import id_key
from .operators.proximity import locate_in_regions, neighbours_within, usable
from .operators.references import orphan_references, orphan_report


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows of both tables with their loaded_at: null ids excluded, a null slide with an id is an orphan (match full)."""
    cells = read(spark, d, "cells").select("sample_id", id_key("cell_id").alias("cell_key"), "loaded_at", "removed_at")
    parts = []
    for table, col in (("cell_groups", "cell_id"), ("clusters", "barcode")):
        refs = read(spark, d, table).filter(F.col(col).isNotNull()).select("row_id", "sample_id", id_key(col).alias("cell_key"), "loaded_at")
        parts.append(orphan_references(refs, cells, {"sample_id": "sample_id", "cell_key": "cell_key"}, "loaded_at", "loaded_at", "removed_at", "full").select(F.lit(table).alias("table_name"), "row_id", "loaded_at"))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id").distinct()


def p2_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d).distinct(), "loaded_at", ["table_name"])


_ORPHANS_SQL = """
with lives as (select sample_id, lower(trim(cell_id)) k, min(loaded_at) born, min(removed_at) died from cells group by 1, 2),
refs as (select 'cell_groups' table_name, row_id, sample_id, lower(trim(cell_id)) k, loaded_at from cell_groups where cell_id is not null
  union all select 'clusters', row_id, sample_id, lower(trim(barcode)), loaded_at from clusters where barcode is not null),
orphans as (select distinct r.table_name, r.row_id, r.loaded_at from refs r left join lives l on r.sample_id = l.sample_id and r.k = l.k
  where l.k is null or r.loaded_at is null or l.born > r.loaded_at or l.died <= r.loaded_at)
"""


def _locations(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "cells").filter(usable("spatial_x", "spatial_y"))
    return cells.select("sample_id", "cell_ix", (F.col("spatial_x") * F.col("microns_per_pixel")).alias("x_um"), (F.col("spatial_y") * F.col("microns_per_pixel")).alias("y_um"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours_within(_locations(spark, d), "sample_id", "cell_ix", "x_um", "y_um", 4.0)
    return near.select(F.col("a").alias("cell_a"), F.col("b").alias("cell_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Other cells within 15 µm, with the least outline gap that an edge of either graph gives for the pair (null: no edge)."""
    near = neighbours_within(_locations(spark, d), "sample_id", "cell_ix", "x_um", "y_um", 15.0)
    edges = read(spark, d, "cell_edges").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(~F.isnan("wall_dist_um") & (F.col("wall_dist_um") >= 0), F.col("wall_dist_um")).alias("w"))
    gaps = edges.groupBy("a", "b").agg(F.min("w").alias("gap_um"))
    return near.join(gaps, ["a", "b"], "left").select("sample_id" if "sample_id" in near.columns else F.col("space").alias("sample_id"), F.col("a").alias("cell_a"), F.col("b").alias("cell_b"), F.round("distance", 6).alias("distance_um"), F.round("gap_um", 6).alias("gap_um"))


_LOC_SQL = """loc as (select distinct sample_id, cell_ix, spatial_x * microns_per_pixel x, spatial_y * microns_per_pixel y from cells
  where spatial_x is not null and spatial_y is not null and not isnan(spatial_x) and not isnan(spatial_y) and not (spatial_x = 0 and spatial_y = 0))"""


def _near_sql(r: str) -> str:
    return f"""{_LOC_SQL}, grid as (select *, cast(floor(x / {r}) as bigint) gx, cast(floor(y / {r}) as bigint) gy from loc),
  near as (select a.sample_id, a.cell_ix cell_a, b.cell_ix cell_b, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) d
    from (select *, gx + dx hx, gy + dy hy from grid, (values (-1), (0), (1)) t(dx), (values (-1), (0), (1)) u(dy)) a join grid b on a.sample_id = b.sample_id and a.hx = b.gx and a.hy = b.gy and a.cell_ix < b.cell_ix
    where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {r} group by 1, 2, 3)"""


def p2_partial_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows of cell_groups whose slide and id, as far as they are known, no cell ever had: match partial, so each mask of nulls is held against its own columns."""
    cells = read(spark, d, "cells").select("sample_id", id_key("cell_id").alias("cell_key"))
    refs = read(spark, d, "cell_groups").select("row_id", "sample_id", id_key("cell_id").alias("cell_key"))
    return orphan_references(refs, cells, {"sample_id": "sample_id", "cell_key": "cell_key"}, match="partial").select("row_id").distinct()


#: Slants and side of the parallelograms below.
_SLANTS, _SIDE = (0.3, 0.2), 250.0


def p6_slanted_regions(spark: SparkSession, d: str) -> DataFrame:
    """The parallelogram of a slanted lattice that contains each cell, found as a point in polygons of slanted edges."""
    at = _locations(spark, d)
    a, b = _SLANTS
    u, v = F.floor((F.col("x_um") - a * F.col("y_um")) / _SIDE), F.floor((F.col("y_um") - b * F.col("x_um")) / _SIDE)
    boxes = at.select("sample_id", u.alias("u"), v.alias("v")).distinct()
    corner = lambda i, j: F.struct(((F.col("u") + i + a * (F.col("v") + j)) * (_SIDE / (1 - a * b))).alias("x"), ((F.col("v") + j + b * (F.col("u") + i)) * (_SIDE / (1 - a * b))).alias("y"))
    regions = boxes.select("sample_id", F.concat_ws(":", "u", "v").alias("region"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    found = locate_in_regions(at, regions, "sample_id", "cell_ix", "x_um", "y_um", "region", "ring", _SIDE)
    return found.select(F.col("space").alias("sample_id"), F.col("id").alias("cell_ix"), "region")


QUERIES = {
    "p2_partial_orphans": p2_partial_orphans,
    "p6_slanted_regions": p6_slanted_regions,
    "p2_found": p2_found,
    "p2_orphans_by_month": p2_orphans_by_month,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
}

SQL = {
    "p2_partial_orphans": """with k as (select distinct sample_id s, lower(trim(cell_id)) k from cells) select distinct row_id from cell_groups g
  where (sample_id is not null or cell_id is not null) and not exists (select 1 from k where (g.sample_id is null or k.s = g.sample_id) and (g.cell_id is null or k.k = lower(trim(g.cell_id))))""",
    "p6_slanted_regions": f"""select distinct sample_id, cell_ix, cast(floor((x - 0.3 * y) / 250) as bigint) || ':' || cast(floor((y - 0.2 * x) / 250) as bigint) as region
  from (select sample_id, cell_ix, spatial_x * microns_per_pixel x, spatial_y * microns_per_pixel y from cells
    where spatial_x is not null and spatial_y is not null and not isnan(spatial_x) and not isnan(spatial_y) and not (spatial_x = 0 and spatial_y = 0))""",
    "p2_found": _ORPHANS_SQL + "select distinct table_name, row_id from orphans",
    "p2_orphans_by_month": _ORPHANS_SQL + "select table_name, strftime(date_trunc('month', loaded_at), '%Y-%m') as month, count(*) as n_orphans from orphans group by 1, 2",
    "p6_found": f"with {_near_sql('4.0')} select distinct cell_a, cell_b from near",
    "p6_neighbours": f"""with {_near_sql('15.0')}, gaps as (select least(i, j) a, greatest(i, j) b, min(wall_dist_um) filter (where wall_dist_um >= 0 and not isnan(wall_dist_um)) gap from cell_edges group by 1, 2)
  select sample_id, cell_a, cell_b, round(d, 6) as distance_um, round(gap, 6) as gap_um from near left join gaps on cell_a = a and cell_b = b""",
}

QUERIES |= graph.QUERIES | data.QUERIES
SQL |= graph.SQL | data.SQL
