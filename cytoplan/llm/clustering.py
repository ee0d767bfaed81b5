"""Grouping vectors into similarity clusters by grid density."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .components import components
from .vectors import prints

#: Width of a grid cell in standard deviations of the noise (the median axis).
CELL_WIDTH = 4.0
#: An axis is a feature if its second moment exceeds the median one this many times; at most MOST_AXES at a look, the strongest. Groups outside them are found by the next look.
SIGNAL, MOST_AXES = 1.5, 16
#: A cell is dense from so many different vectors, and a group has so many in dense cells at least, whatever the number of all vectors.
LEAST_POINTS, LEAST_GROUP = 4, 10
#: Connected cells whose mean directions are this similar are one group.
SAME_DIRECTION = 0.7
#: Least length of the mean of a group's vectors, whose square is their mean similarity to each other; scattered vectors meet at the origin and have none.
LEAST_TIGHTNESS = 0.35
#: A vector belongs to its cell's group, or else to the nearest, from this share of the mean similarity of the group's core.
REACH = 0.75
#: Directions compared with all others, or with all vectors, at once.
DIRECTIONS_AT_ONCE = 4096


def _matrix(batch: pa.RecordBatch, name: str = "unit") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _partial(rows: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over partitions of arrays of one bounded shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = part(b) if total is None else total + part(b)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "m binary").toLocalIterator():
        out += np.frombuffer(r["m"], float).reshape(shape)
    return out


def _axes(units: DataFrame, width: int, n: int) -> tuple[np.ndarray, float]:
    """Features (width x axes) and the width of a grid cell, from the second moments of all vectors."""
    values, vectors = np.linalg.eigh(_partial(units.select("unit"), lambda b: (x := _matrix(b)).T @ x, (width, width)) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    noise = max(float(np.median(values)), 1e-12)
    k = min(max(1, int((values > SIGNAL * noise).sum())), MOST_AXES)
    return vectors[:, :k], CELL_WIDTH * float(np.sqrt(noise))


def _blocks(directions: DataFrame) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(keys, directions, tightness) of DIRECTIONS_AT_ONCE groups after each other; directions: key, total (array), n."""
    keys, rows, n = [], [], []
    for r in directions.select("key", "total", "n").orderBy("key").toLocalIterator():
        keys.append(r["key"])
        rows.append(r["total"])
        n.append(r["n"])
        if len(keys) == DIRECTIONS_AT_ONCE:
            yield _scaled(keys, rows, n)
            keys, rows, n = [], [], []
    if keys:
        yield _scaled(keys, rows, n)


def _scaled(keys: list, rows: list, n: list) -> tuple[list[int], np.ndarray, np.ndarray]:
    total = np.array(rows, float)
    norm = np.linalg.norm(total, axis=1)
    return keys, total / np.maximum(norm, 1e-12)[:, None], norm / np.array(n, float)


def _sums(rows: DataFrame, by: str, width: int, weight: str | None = None) -> DataFrame:
    """by, total (array of the sums of unit, or total, times weight), n."""
    vector = "total" if weight else "unit"
    times = F.col(weight) if weight else F.lit(1.0)
    total = F.array(*(F.sum(F.get(vector, F.lit(k)).cast("double") * times) for k in range(width)))
    return rows.groupBy(by).agg(total.alias("total"), F.sum("n" if weight else F.lit(1)).cast("double").alias("n"))


def _one_look(units: DataFrame, scratch: Scratch, width: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(units with the grid's group and the cell's size, null and 0 outside dense cells; groups: key, total, n in dense cells)."""
    axes, step = _axes(units, width, n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                grid = np.floor(x @ axes / step + 0.5).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1]), pa.array(grid.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints(grid, 21)), lists, pa.array(prints(x, 11))], names=[*b.schema.names, "key", "cell", "print"])

    fields = ", ".join(f"`{c}` {t}" for c, t in units.dtypes)
    placed = scratch.table(units.mapInArrow(place, fields + ", key bigint, cell array<int>, print bigint"), "placed")
    cells = placed.groupBy("key").agg(F.count_distinct("print").alias("n"), F.first("cell").alias("cell"))
    dense = scratch.table(cells.filter(F.col("n") >= LEAST_POINTS), "dense")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = _matrix(b, "cell").astype(np.int32)
                moves = np.concatenate([np.zeros((1, c.shape[1]), np.int32), np.eye(c.shape[1], dtype=np.int32), -np.eye(c.shape[1], dtype=np.int32)])
                to = prints((c[:, None, :] + moves[None]).reshape(-1, c.shape[1]), 21)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(np.repeat(np.arange(len(c)), len(moves)))), pa.array(to)], names=["key", "to"])

    near = dense.select("key", "cell").mapInArrow(around, "key bigint, to bigint").join(dense.select(F.col("key").alias("to"), F.col("n").alias("there")), "to")
    uphill = near.groupBy("key").agg(F.max_by("to", F.struct("there", "to")).alias("to"))
    labels = scratch.table(components(uphill, "key", "to").join(dense.select(F.col("key").alias("node"), F.col("n").alias("cell_size")), "node").withColumnRenamed("node", "key"), "labels")
    labelled = scratch.table(placed.join(labels, "key", "left").select(*units.columns, "key", "component", "cell_size"), "labelled")
    scratch.drop("placed")
    # A cell's mean counts once for each different vector, so copies can't bend a group.
    by_cell = _sums(labelled.filter("component is not null"), "key", width).join(labels, "key")
    parts = by_cell.select(F.col("component").alias("key"), "total", F.col("cell_size").alias("n"), (F.col("cell_size") / F.col("n")).alias("weight"))
    length = F.sqrt(F.aggregate("total", F.lit(0.0), lambda a, v: a + v * v))
    roots = scratch.table(_sums(parts, "key", width, "weight").filter((F.col("n") >= LEAST_GROUP) & (length >= LEAST_TIGHTNESS * F.col("n"))), "roots")
    pairs = [roots.select(F.col("key").alias("a"), F.col("key").alias("b"))]
    for keys, directions, _ in _blocks(roots):

        def alike(batches: Iterator[pa.RecordBatch], keys=keys, directions=directions) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b, "total")
                    i, j = np.nonzero(x @ directions.T >= SAME_DIRECTION * np.linalg.norm(x, axis=1)[:, None])
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(i)), pa.array(np.array(keys, np.int64)[j])], names=["a", "b"])

        pairs.append(roots.select("key", "total").mapInArrow(alike, "a bigint, b bigint"))
    united = scratch.table(components(reduce(DataFrame.unionByName, pairs), "a", "b").select(F.col("node").alias("root"), F.col("component").alias("grp")), "united")
    groups = _sums(roots.join(united, roots["key"] == united["root"]).select(F.col("grp").alias("key"), "total", "n", F.lit(1.0).alias("weight")), "key", width, "weight")
    known = labelled.join(united, F.col("component") == F.col("root"), "left")
    return known.select(*units.columns, "grp", F.coalesce("cell_size", F.lit(0)).cast("bigint").alias("cell_size")), scratch.table(groups, "groups")


def _unlike(groups: DataFrame, earlier: DataFrame) -> DataFrame:
    """groups whose direction is none of the earlier ones': what lies out of a group's reach on its side is no group of its own."""
    for _, directions, _ in _blocks(earlier):

        def other(batches: Iterator[pa.RecordBatch], directions=directions) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b, "total")
                    yield b.filter(pa.array((x @ directions.T).max(axis=1) < SAME_DIRECTION * np.linalg.norm(x, axis=1)))

        groups = groups.mapInArrow(other, groups.schema)
    return groups


def _assigned(placed: DataFrame, groups: DataFrame, keep: list[str], types: dict[str, str]) -> DataFrame:
    """keep, unit (null for those taken), grp (null out of reach), similarity to it, cell_size: the group of the vector's cell if that is in reach, else the nearest."""
    rows = placed.select(*keep, "unit", "cell_size", "grp", F.lit(None).cast("bigint").alias("best"), F.lit(-2.0).alias("similarity"), F.lit(2.0).alias("tight"))
    fields = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", unit array<float>, cell_size bigint, grp bigint, best bigint, similarity double, tight double"
    for keys, directions, tight in _blocks(groups):

        def nearer(batches: Iterator[pa.RecordBatch], keys=np.array(keys, np.int64), directions=directions, tight=tight) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                sims = _matrix(b) @ directions.T
                own = b.column("grp").fill_null(-1).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)  # keys are sorted
                mine = b.column("grp").is_valid().to_numpy(zero_copy_only=False) & (keys[at] == own)
                each = np.arange(len(sims))
                mine &= sims[each, at] >= REACH * tight[at]
                pick = np.where(mine, at, sims.argmax(axis=1))
                old, sim = b.column("similarity").to_numpy(), sims[each, pick]
                settled = b.column("tight").to_numpy() < 0  # by its cell, in an earlier block
                new = ~settled & (mine | (sim > old))
                best = np.where(new, keys[pick], b.column("best").fill_null(0).to_numpy(zero_copy_only=False))
                worth = np.where(mine & new, -1.0, np.where(new, tight[pick], b.column("tight").to_numpy()))
                columns = [*(b.column(c) for c in [*keep, "unit", "cell_size", "grp"]), pa.array(best), pa.array(np.where(new, sim, old)), pa.array(worth)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "unit", "cell_size", "grp", "best", "similarity", "tight"])

        rows = rows.mapInArrow(nearer, fields)
    ok = (F.col("tight") < 0) | (F.col("similarity") >= REACH * F.col("tight"))
    taken = ok & F.col("best").isNotNull()
    return rows.select(*keep, F.when(~taken, F.col("unit")).alias("unit"), F.when(taken, F.col("best")).alias("grp"), F.greatest("similarity", F.lit(-1.0)).alias("similarity"), "cell_size")


def density_groups(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of mutually similar unit vectors.

    vectors: id, unit (array of one length), and any other columns. Returns the members (id, group_id, similarity to the group's direction, cell_size:
    different vectors in its grid cell if that is dense, core, and the other columns; group_id null for a vector unlike every group) and the groups (group_id, n, tightness).

    Vectors are projected on the axes that stand out of the noise and quantised to a grid; each cell's different vectors are counted, dense cells joined to the densest of
    their neighbours (cells that differ by one step on one axis), so that valleys separate groups, and the least label spreads along those joins to
    convergence. Connected cells of one direction are united. A vector keeps its cell's group if it is in reach of its direction, others go to the nearest group in reach. What no
    group took is looked at again in the same way, with axes of its own, until nothing is found, so that a group's least size depends on no total (but among n scattered
    vectors it must stand out of their noise, with about n / 2 / width members). Cells, labels and sums stay distributed; only moments of one bounded shape and directions, DIRECTIONS_AT_ONCE at once,
    reach the driver. Density counts different vectors, so copies of one never make or bend a group. No vectors: no rows; with no dense cell nothing has a group.
    """
    spark = vectors.sparkSession
    source = Scratch(spark)
    rest = source.table(vectors.withColumn("unit", F.col("unit").cast("array<float>")), "units")
    types = dict(rest.dtypes)
    keep = ["id", *(c for c in rest.columns if c not in ("id", "unit"))]
    found: list[DataFrame] = []
    seen: list[DataFrame] = []
    look = 0
    while True:
        head = rest.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("unit")).alias("w")).collect()[0]
        n, width = int(head["n"]), int(head["w"] or 1)
        scratch = Scratch(spark)
        if n < LEAST_GROUP:
            break
        placed, groups = _one_look(rest, scratch, width, n)
        if seen:
            groups = scratch.table(_unlike(groups, reduce(DataFrame.unionByName, seen)), "new")
        if not groups.limit(1).count():
            break
        seen.append(groups)
        taken = scratch.table(_assigned(placed, groups, keep, types), "taken")
        for name in ("dense", "labels", "labelled", "roots", "united"):
            scratch.drop(name)
        if not look:
            source.drop("units")
        found.append(taken.filter("grp is not null").select(*keep, F.lit(look).alias("look"), "grp", "similarity", "cell_size"))
        rest, look = taken.filter("grp is null").select(*keep, "unit"), look + 1
    none = rest.select(*keep, F.lit(None).cast("int").alias("look"), F.lit(None).cast("bigint").alias("grp"), F.lit(None).cast("double").alias("similarity"), F.lit(0).cast("bigint").alias("cell_size"))
    all_ = reduce(DataFrame.unionByName, found, none)
    sizes = all_.filter("grp is not null").groupBy("look", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("tightness"))
    names = Scratch(spark).table(sizes.withColumn("group_id", (F.row_number().over(Window.orderBy(F.desc("n"), "look", "grp")) - 1).cast("bigint")), "names")  # a row per group
    members = all_.join(names.select("look", "grp", "group_id"), ["look", "grp"], "left").select(*keep, "group_id", "similarity", "cell_size", (F.col("cell_size") > 0).alias("core"))
    return members, names.select("group_id", "n", "tightness")


def typical_members(members: DataFrame, k: int) -> DataFrame:
    """group_id, rank, id, similarity, cell_size: of each group the k members of the densest cells, nearest to its direction first.

    Groups may be large, so pieces by hash send their own k best first.
    """
    order = [F.desc("cell_size"), F.desc("similarity"), "id"]
    part = members.filter("group_id is not null").select("group_id", "id", "similarity", "cell_size").withColumn("__p", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = part.withColumn("__r", F.row_number().over(Window.partitionBy("group_id", "__p").orderBy(*order))).filter(F.col("__r") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).filter(F.col("rank") <= k).select("group_id", "rank", "id", "similarity", "cell_size")


def against_labels(members: DataFrame, label: str) -> DataFrame:
    """id, group_id, label, usual: members with a label, and the label most members of their group have (ties: the least)."""
    known = members.filter(F.col("group_id").isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy("group_id", label).agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("group_id").agg(F.max_by(F.col(label), F.struct("n", (-F.col(label)).alias("l"))).alias("usual"))
    return known.join(usual, "group_id").select("id", "group_id", F.col(label).alias("label"), "usual")
