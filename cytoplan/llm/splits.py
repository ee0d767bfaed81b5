"""Splits that keep related records together: ties, connected sets and grouped iterative stratification."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .components import components

#: Connected sets placed by one task. If there are more, those with the rarest labels, up to so many, are placed before the rest.
BLOCK_SETS = 4000
#: A set with over one in so many of all records is placed before the others, in one task; there are at most that many.
LARGE_SHARE = 1000


def ties_by_key(rows: DataFrame, group: str, key: str, least: int) -> DataFrame:
    """Pairs of groups, a < b, that hold at least `least` equal keys: a, b, n_common (of the keys compared; at least `least`).

    Keys held by one group are dropped first. Of each group the least - 1 most widespread keys propose no pair (two groups with `least`
    common keys also share one outside them), so a key that all groups hold costs nothing; they are still counted for the pairs others
    propose. Nulls in either column are left out, repeats count once.
    """
    held = rows.select(F.col(group).alias("g"), F.col(key).alias("k")).dropna().distinct()
    spread = held.groupBy("k").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    held = held.join(spread, "k")
    classes = held.groupBy("g", "f").agg(F.count(F.lit(1)).alias("c"))
    above = classes.withColumn("above", F.sum("c").over(Window.partitionBy("g").orderBy(F.desc("f")))).select("g", "f", "above")
    held = cut(held.join(above, ["g", "f"]).select("g", "k", (F.col("above") >= least).alias("proposes")))
    side = lambda df, n: df.select(F.col("g").alias(n), "k")
    kept, rest = held.filter("proposes"), held.filter(~F.col("proposes"))
    found = cut(side(kept, "a").join(side(kept, "b"), "k").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    sure, unsure = found.filter(F.col("n") >= least), found.filter(F.col("n") < least)
    one = unsure.join(side(rest, "a"), "a").join(side(held, "b"), ["b", "k"]).select("a", "b")
    two = unsure.join(side(rest, "b"), "b").join(side(kept, "a"), ["a", "k"]).select("a", "b")
    more = unsure.select("a", "b", "n").unionByName(one.unionByName(two).withColumn("n", F.lit(1).cast("bigint"))).groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return sure.unionByName(more).withColumnRenamed("n", "n_common")


def ties_by_place(rows: DataFrame, group: str, x: str, y: str, radius: float, least: int) -> DataFrame:
    """Pairs of groups, a < b, of which one has at least `least` points within radius of a point of the other: a, b, n_common.

    Points at one place of a group are merged with their number before the join. Coordinates must be finite.
    """
    at = rows.select(F.col(group).alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).dropna().groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    wide = 4 * radius  # cells of four radii: most points lie in reach of one cell only
    cell = lambda c: F.floor(F.col(c) / wide)
    over = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius * (1 + 1e-9)) / wide), F.floor((F.col(c) + radius * (1 + 1e-9)) / wide)))
    left = at.select(F.col("g").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("n").alias("an"), cell("x").alias("cx"), cell("y").alias("cy"))
    right = at.select(F.col("g").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("bn"), over("x").alias("cx")).withColumn("cy", over("by"))
    near = left.join(right, ["cx", "cy"]).filter(F.col("a") < F.col("b")).filter(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= radius)
    near = cut(near.drop("cx", "cy"))
    count = lambda p, n: near.groupBy("a", "b", f"{p}x", f"{p}y").agg(F.first(n).alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return count("a", "an").unionByName(count("b", "bn")).groupBy("a", "b").agg(F.max("n").alias("n_common")).filter(F.col("n_common") >= least)


def connected_sets(ties: list[DataFrame]) -> DataFrame:
    """node, component of all groups with a tie."""
    edges = reduce(DataFrame.unionByName, (t.select("a", "b") for t in ties)).distinct()
    return components(cut(edges), "a", "b")


def pairs_within(sets: DataFrame) -> DataFrame:
    """All pairs a < b of a connected set; as many as the result must have."""
    side = lambda n: sets.select(F.col("node").alias(n), "component")
    return side("a").join(side("b"), "component").filter("a < b").select("a", "b")


def place(sets: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Split of each set by iterative stratification. sets: records by set and label; demand: wanted records by split and label, changed in place.

    The label with fewest outstanding records among its unplaced sets goes first, its sets by falling number, each into the split that
    lacks that label most (then most records overall, then the lower number). Sets without records go to the neediest split.
    """
    n, split = len(sets), np.full(len(sets), -1)
    left = sets.sum(axis=0).astype(float)
    while (split < 0).any():
        labels = np.flatnonzero(left > 0)
        if not len(labels):
            for s in np.flatnonzero(split < 0):
                split[s] = int(np.argmax(demand.sum(axis=1)))
            break
        rare = labels[np.argmin(left[labels])]
        own = np.flatnonzero((split < 0) & (sets[:, rare] > 0))
        for s in own[np.argsort(-sets[own, rare], kind="stable")]:
            need = demand[:, rare]
            best = np.flatnonzero(need >= need.max() - 1e-9)
            split[s] = best[np.argmax(demand[best].sum(axis=1))]
            demand[split[s]] -= sets[s]
            left -= sets[s]
    assert n == len(split)
    return split


def stratified_splits(labelled: DataFrame, group: str, label: str, sets: DataFrame, splits: dict[str, float]) -> DataFrame:
    """group, component, split: every group placed so that connected ones share a split and labels keep the proportions of splits.

    labelled: a row per record with its group and label (null counts as a label of its own); sets: node, component of the tied groups, others
    stand alone. Up to BLOCK_SETS sets are placed in one task, the rarest outstanding label first. Of more, the sets above 1 / LARGE_SHARE of all records and those that hold the rarest labels, as
    many labels as BLOCK_SETS sets hold, are placed first, in that order over all of them, so that rare labels keep their proportions; the rest, which hold labels of very many sets, in blocks of about BLOCK_SETS,
    each against its part of what is then still wanted, so neither sets nor records gather in one place. Null groups are left out.
    """
    names, weight = list(splits), np.array(list(splits.values()), float)
    weight = weight / weight.sum()
    rows = labelled.select(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("l")).filter("g is not null")
    counts = rows.groupBy("g", "l").agg(F.count(F.lit(1)).alias("n"))
    member = counts.select("g").distinct().join(sets.select(F.col("node").alias("g"), "component"), "g", "left").withColumn("component", F.coalesce("component", "g"))
    vectors = counts.join(member, "g").groupBy("component", "l").agg(F.sum("n").alias("n"))
    vectors = vectors.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("v"), F.sum("n").alias("n"))
    totals = {r["l"]: int(r["n"]) for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # one row per label
    labels, all_rows = sorted(totals), max(1, sum(totals.values()))
    where = {x: k for k, x in enumerate(labels)}
    n_sets = vectors.count()

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(pdf), len(labels)))
        for r, v in enumerate(pdf["v"]):
            for k, c in v.items() if isinstance(v, dict) else v:
                out[r, where[k]] = c
        return out

    def assign(pdf: pd.DataFrame, demand: np.ndarray) -> pd.DataFrame:
        pdf = pdf.sort_values("component").reset_index(drop=True)
        return pd.DataFrame({"component": pdf["component"], "split": [names[s] for s in place(matrix(pdf), demand)]})

    schema = f"component {dict(member.dtypes)['component']}, split string"
    want = weight[:, None] * np.array([totals[x] for x in labels], float)[None, :]
    is_large = F.lit(True)
    if n_sets > BLOCK_SETS:
        held = {r["l"]: r["n"] for r in vectors.select(F.explode(F.map_keys("v")).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per label
        rare, room = [], BLOCK_SETS
        for x in sorted(labels, key=lambda x: (totals[x], x)):
            room -= held[x]
            if room < 0:
                break
            rare.append(x)
        is_large = F.col("n") * LARGE_SHARE > all_rows
        is_large |= F.arrays_overlap(F.map_keys("v"), F.array(*map(F.lit, rare))) if rare else F.lit(False)
    large = vectors.filter(is_large)
    first = large.groupBy(F.pmod(F.xxhash64("component"), F.lit(1))).applyInPandas(lambda pdf: assign(pdf, want.copy()), schema)
    done = large.join(first, "component").select("split", F.explode("v").alias("l", "n")).groupBy("split", "l").agg(F.sum("n").alias("n")).collect()  # splits x labels
    rest, taken = want.copy(), np.zeros(len(labels))
    for r in done:
        rest[names.index(r["split"]), where[r["l"]]] -= r["n"]
        taken[where[r["l"]]] += r["n"]
    open_ = np.maximum(np.array([totals[x] for x in labels], float) - taken, 1e-9)
    blocks = max(1, -(-n_sets // BLOCK_SETS))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return assign(pdf, rest * (matrix(pdf).sum(axis=0) / open_)[None, :])

    other = vectors.filter(~is_large).groupBy(F.pmod(F.xxhash64("component"), F.lit(blocks))).applyInPandas(lambda pdf: block(pdf), schema)
    return member.join(first.unionByName(other), "component").select(F.col("g").alias(group), "component", "split")
