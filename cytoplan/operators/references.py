"""References to records that do not exist: orphan detection for composite keys with partial nulls and lifetimes."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import hot_keys, salted

FOREVER = "9999-12-31 00:00:00"


def lifetimes(records: DataFrame, keys: list[str], born: str, died: str | None) -> DataFrame:
    """One row per key and end: first birth and earliest end over all deliveries of a key; an end of null means still valid."""
    end = F.coalesce(F.min(died), F.lit(FOREVER).cast("timestamp")) if died else F.lit(FOREVER).cast("timestamp")
    return records.groupBy(*keys).agg(F.min(born).alias("__born"), end.alias("__died"))


def orphan_references(refs: DataFrame, records: DataFrame, on: dict[str, str], ref_time: str | None = None, born: str | None = None, died: str | None = None, match: str = "simple") -> DataFrame:
    """Rows of refs that point to no row of records.

    on maps each column of refs to its column of records. References are grouped by null mask and each mask is anti-joined on its
    non-null columns. match declares what a mask means, as in SQL's foreign keys:

    * simple: a reference with any null is not checked and never an orphan.
    * partial: the non-null columns must match some record; all null is not checked.
    * full: all null is not checked; a mix of null and non-null is always an orphan.

    With ref_time, a record counts only while it lives: born (first delivery) <= ref_time < died (null: for ever); a null ref_time
    matches nothing. Without it any record counts. Repeated rows of refs are all returned; columns of records never reach the result,
    so names may clash. Empty refs give no rows, empty records make every checked reference an orphan. Nulls in records' key columns
    match nothing. Hot keys of refs are salted, and records are aggregated to one row per key before any join.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    ref_cols = list(on)
    names = [f"__k{n}" for n in range(len(ref_cols))]
    left = refs.select("*", *(F.col(c).alias(k) for c, k in zip(ref_cols, names)), F.struct(*(F.col(c) for c in refs.columns)).alias("__row"))
    left = left.select(*names, "__row", *( [F.col(ref_time).cast("timestamp").alias("__at")] if ref_time else []))
    right = records.select(*(F.col(on[c]).alias(k) for c, k in zip(ref_cols, names)), *([F.col(born).cast("timestamp").alias("__b")] if born else [F.lit("0001-01-01 00:00:00").cast("timestamp").alias("__b")]), *([F.col(died).cast("timestamp").alias("__d")] if died else []))
    whole = right.dropna(subset=names)
    whole = lifetimes(whole, names, "__b", "__d" if died else None)
    parts = []
    for mask in product((False, True), repeat=len(names)):  # True: null
        here = reduce(lambda x, y: x & y, (F.col(k).isNull() if m else F.col(k).isNotNull() for k, m in zip(names, mask)))
        rows = left.filter(here)
        keys = [k for k, m in zip(names, mask) if not m]
        if not keys or (any(mask) and match == "simple"):
            continue
        if any(mask) and match == "full":
            parts.append(rows.select("__row"))
            continue
        lives = whole if not any(mask) else _merged(right, names, keys, bool(died))
        parts.append(_unmatched(rows, lives, keys, bool(ref_time)))
    if not parts:
        return refs.limit(0)
    return reduce(DataFrame.unionByName, parts).select("__row.*")


def _merged(right: DataFrame, names: list[str], keys: list[str], died: bool) -> DataFrame:
    """Lifetimes under a partial key: whole keys first, then one row per end, so records that never end collapse to one."""
    whole = lifetimes(right.dropna(subset=keys), names, "__b", "__d" if died else None)
    return whole.groupBy(*keys, "__died").agg(F.min("__born").alias("__born"))


def _unmatched(rows: DataFrame, lives: DataFrame, keys: list[str], timed: bool) -> DataFrame:
    hot = hot_keys(rows, keys)
    a, b = salted(rows, lives, keys, hot, ["__row"])
    same = reduce(lambda x, y: x & y, (a[k] == b[k] for k in [*keys, "__salt"]))
    if timed:
        same = same & (b["__born"] <= a["__at"]) & (a["__at"] < b["__died"])
    return a.join(b, same, "left_anti").select("__row")


def orphan_report(orphans: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """Orphans per table and month: columns of by, month (null where time is null) and n_orphans."""
    return orphans.groupBy(*(by or []), F.date_format(F.date_trunc("month", F.col(time)), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
