"""Aligning tables on cells: keep-first joins, label folding, codes, masks and subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order; rows with a null key are dropped. Aggregates before the shuffle, so repeated keys cost little."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.struct(*rest)
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def left_attach(cells: DataFrame, other: DataFrame, keys: list[str], order: list[str], found: str | None = None) -> DataFrame:
    """cells with the columns of other's first row per key; null, and found false, where there is none. Columns of the same name keep cells' values."""
    extra = [c for c in other.columns if c not in cells.columns]
    one = keep_first(other.select(*keys, *dict.fromkeys([*extra, *(c for c in order if c not in keys)])), keys, order).select(*keys, *extra, F.lit(True).alias("__found"))
    out = cells.join(one, keys, "left")
    return out.withColumn(found, F.coalesce("__found", F.lit(False))).drop("__found") if found else out.drop("__found")


def folded_label(label: str | Column, filler: str = "Unassigned") -> Column:
    """Null labels, blanks and any spelling of the filler are one class, the filler."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c.isNull() | (F.lower(F.trim(c)) == filler.lower()) | (F.trim(c) == ""), F.lit(filler)).otherwise(c)


def filler_spelling(rows: DataFrame, label: str, filler: str = "Unassigned") -> str:
    """The panel's own spelling of the filler (the least, if it has several), else the filler: what folded_label takes to keep it."""
    found = rows.filter(F.lower(F.trim(label)) == filler.lower()).agg(F.min(label).alias("s")).collect()[0]["s"]
    return found if found is not None else filler


def dense_codes(rows: DataFrame, name: str) -> DataFrame:
    """name, code: distinct non-null values numbered from 0 by name. The values are few (a dictionary), so one task orders them."""
    return rows.select(name).dropna().distinct().withColumn("code", (F.dense_rank().over(Window.orderBy(name)) - 1).cast("bigint"))


def codes_by_appearance(rows: DataFrame, name: str, order: str) -> DataFrame:
    """name, code: distinct values numbered from 0 by the least order value they occur at (ties: by name)."""
    first = rows.dropna(subset=[name]).groupBy(name).agg(F.min(order).alias("__o"))
    return first.select(name, (F.row_number().over(Window.orderBy("__o", name)) - 1).cast("bigint").alias("code"))


def nearest_to_median(cells: DataFrame, x: str, y: str, ident: str, n: int) -> DataFrame:
    """The n cells nearest to the median position (ties: by ident); coordinates must be finite. The medians are found by counts of ranges."""
    from .batching import exact_median

    mx, my = exact_median(cells, x, ident), exact_median(cells, y, ident)
    if mx is None or my is None:
        return cells.limit(0)
    return cells.withColumn("__d", F.hypot(F.col(x) - F.lit(mx), F.col(y) - F.lit(my))).orderBy("__d", ident).limit(n).drop("__d")


def pivot_clusterings(rows: DataFrame, keys: list[str], clustering: str, number: str, order: list[str], names: list[str]) -> DataFrame:
    """keys and one column Cluster-<n> per clustering in names: the first row of each cell and clustering."""
    one = keep_first(rows.select(*keys, clustering, number, *(c for c in order if c not in keys)), [*keys, clustering], order)
    text = F.concat(F.lit("Cluster-"), F.col(number).cast("int").cast("string"))
    return one.groupBy(*keys).pivot(clustering, names).agg(F.first(text))


def unique_names(name: str, order: str) -> Column:
    """name, with -1, -2, ... from its second occurrence on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return F.when(n == 0, F.col(name)).otherwise(F.concat_ws("-", name, n.cast("string")))


def centre_and_mask(cells: DataFrame, vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """cells with vector (zeros where there is none) and found; raises if no cell has one, as a whole miss means the wrong file."""
    out = left_attach(cells, vectors.select(key, vector), [key], [key], "found")
    if not out.filter("found").limit(1).count():
        raise ValueError("no vector belongs to any cell")
    return out.withColumn(vector, F.coalesce(F.col(vector), F.array_repeat(F.lit(0.0).cast("float"), width)))
