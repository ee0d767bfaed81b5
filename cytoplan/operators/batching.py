"""Batches, tiles, splits and samples, all reproducible by hashes of ids."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .graph import directed

#: Fixed value: multiplier of the hash that SQL engines share (id * MULTIPLIER mod 2^32).
MULTIPLIER = 2654435761


def shuffle_key(ident: str | Column, seed: int = 0) -> Column:
    """A pseudo-random order of ids: (id + seed) * MULTIPLIER mod 2^32."""
    c = F.col(ident) if isinstance(ident, str) else ident
    return F.pmod((c + seed).cast("decimal(38,0)") * F.lit(MULTIPLIER).cast("decimal(10,0)"), F.lit(4294967296).cast("decimal(10,0)")).cast("bigint")


def global_rank(rows: DataFrame, order: list[str], bits: int = 10, span: int = 1 << 32) -> DataFrame:
    """rows with __rank from 0 in the given order, of which the first column is a whole number from 0 below span: counts per range of it first, then ranks within ranges, so no task sorts all rows."""
    part = F.floor(F.col(order[0]) / F.lit(max(1.0, span / (1 << bits)))).cast("int")
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # 2^bits rows
    ranked = rows.withColumn("__part", part).withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__part").withColumn("__rank", F.col("__before") + F.col("__r") - 1).drop("__part", "__r", "__before")


#: Ranges a number's span is cut into at each turn of the search for a median, and rows that are then sorted.
MEDIAN_RANGES, MEDIAN_ROWS = 4096, 10_000


def value_at_rank(rows: DataFrame, value: str, ident: str, share: float = 0.5, upper: bool = False) -> DataFrame:
    """The row (all its columns) at place floor((n - 1) * share), or its ceiling if upper, in the order of value and ident: counts per range narrow the span until few rows or one value are left, so no task sorts all rows.

    value must be finite numbers; no rows give none.
    """
    low = rows.filter(F.col(value).isNotNull())
    head = low.agg(F.count(F.lit(1)).alias("n"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).collect()[0]
    if not head["n"]:
        return low.limit(0)
    left, rank, lo, hi = head["n"], (ceil if upper else floor)((head["n"] - 1) * share), head["lo"], head["hi"]
    while left > MEDIAN_ROWS and lo < hi:
        at = F.least(F.floor((F.col(value).cast("double") - lo) / (hi - lo) * MEDIAN_RANGES), F.lit(MEDIAN_RANGES - 1))
        counts = low.groupBy(at.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).orderBy("k").collect()  # MEDIAN_RANGES rows
        for r in counts:
            if rank < r["n"]:
                low, left, lo, hi = low.filter(F.col(value).between(r["lo"], r["hi"])), r["n"], r["lo"], r["hi"]
                break
            rank -= r["n"]
    if left > MEDIAN_ROWS:  # all of one value: by ident, in pieces of its hash order
        return low.orderBy(ident).offset(rank).limit(1)
    return low.orderBy(value, ident).offset(rank).limit(1)


def exact_median(rows: DataFrame, value: str, ident: str) -> float | None:
    """The median of value (the mean of the two middle ones), nulls left out; None without values."""
    middle = [r[0] for up in (False, True) for r in value_at_rank(rows, value, ident, 0.5, up).select(F.col(value).cast("double")).collect()]
    return sum(middle) / 2 if middle else None


def epoch_batches(cells: DataFrame, ident: str, size: int = 64, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """ident, batch_id, seed_index: every cell seeds once, in a shuffled order cut into batches; drop_last leaves out a short tail."""
    rows = cells.select(ident).distinct().withColumn("__h", shuffle_key(ident, seed))
    out = global_rank(rows, ["__h", ident]).select(ident, F.floor(F.col("__rank") / size).alias("batch_id"), F.pmod("__rank", F.lit(size)).cast("int").alias("seed_index"))
    if drop_last:
        full = out.groupBy("batch_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == size)
        out = out.join(full.select("batch_id"), "batch_id", "left_semi")
    return out


def batch_edges(seeds: DataFrame, batch: str, ident: str, edges: DataFrame) -> DataFrame:
    """batch, dst, src: an edge into every seed from each neighbour; two adjacent seeds give both directions, other edges none."""
    one = seeds.select(F.col(batch).alias("batch_id"), F.col(ident).alias("dst")).dropna().distinct()
    return one.join(directed(edges, []).select("dst", "src"), "dst").select("batch_id", "dst", "src")


def batch_nodes(seeds: DataFrame, batch: str, ident: str, edges: DataFrame) -> DataFrame:
    """batch_id, id, local_ix, is_seed: seeds and their neighbours, numbered by id within the batch."""
    one = seeds.select(F.col(batch).alias("batch_id"), F.col(ident).alias("id")).dropna().distinct().withColumn("s", F.lit(1))
    near = batch_edges(seeds, batch, ident, edges).select("batch_id", F.col("src").alias("id")).distinct().withColumn("s", F.lit(0))
    rows = one.unionByName(near).groupBy("batch_id", "id").agg((F.max("s") == 1).alias("is_seed"))
    return rows.withColumn("local_ix", (F.row_number().over(Window.partitionBy("batch_id").orderBy("id")) - 1).cast("bigint"))


#: Ranges of a tile's longer side in which points are ranked, so that no task sorts all points of a large tile.
TILE_RANGES = 1024


def spatial_tiles(points: DataFrame, space: str, ident: str, x: str, y: str, most: int) -> DataFrame:
    """space, id, tile: recursive median splits along the longer side (y only if strictly longer; half the points, rounded down, go left) until a tile has at most `most`.

    A level counts the points of ranges of each tile that is still too large and ranks within ranges; lineage is cut each level, of which there are log2(points / most).
    """
    rows = points.select(F.col(space).alias("space"), F.col(ident).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).dropna().withColumn("tile", F.lit(1).cast("bigint"))
    while True:
        ends = [f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))]
        boxes = rows.groupBy("space", "tile").agg(F.count(F.lit(1)).alias("n"), *ends)
        if not boxes.filter(F.col("n") > most).limit(1).count():
            return rows.select(F.col("space").alias(space), "id", "tile")
        joined = rows.join(boxes, ["space", "tile"])
        tall = (F.col("by") - F.col("ay")) > (F.col("bx") - F.col("ax"))
        pick = lambda c: F.when(tall, F.col(f"{c}y")).otherwise(F.col(f"{c}x"))
        big = joined.filter(F.col("n") > most).withColumn("v", F.when(tall, F.col("y")).otherwise(F.col("x")))
        big = big.withColumn("part", F.floor((F.col("v") - pick("a")) / F.greatest(pick("b") - pick("a"), F.lit(1e-300)) * (TILE_RANGES - 1)).cast("int"))
        counts = big.groupBy("space", "tile", "part").agg(F.count(F.lit(1)).alias("c"))
        before = counts.select("space", "tile", "part", (F.sum("c").over(Window.partitionBy("space", "tile").orderBy("part")) - F.col("c")).alias("before"))
        rank = F.row_number().over(Window.partitionBy("space", "tile", "part").orderBy("v", "id")) + F.col("before")
        split = big.join(before, ["space", "tile", "part"]).withColumn("rank", rank).withColumn("tile", F.col("tile") * 2 + (F.col("rank") > F.floor(F.col("n") / 2)).cast("int"))
        keep = ["space", "id", "x", "y", "tile"]
        rows = cut(split.select(*keep).unionByName(joined.filter(F.col("n") <= most).select(*keep)))


def spatial_split(cells: DataFrame, ident: str, space: str, x: str, y: str, tile: float, margin: float, test_percent: int, seed: int = 0) -> DataFrame:
    """ident, is_test of cells strictly more than margin inside their grid tile; whole tiles are drawn by a hash."""
    tx, ty = F.floor(F.col(x) / tile), F.floor(F.col(y) / tile)
    off = lambda c, t: (F.col(c) - t * tile > margin) & (F.col(c) - t * tile < tile - margin)
    draw = F.pmod(shuffle_key(tx * 1009 + ty * 9176 + 1_000_000, seed), F.lit(100)) < test_percent
    return cells.filter(off(x, tx) & off(y, ty)).select(ident, space, draw.alias("is_test"))


def stratified_sample(rows: DataFrame, ident: str, label: str, per_label: int, least: int = 10, seed: int = 0) -> DataFrame:
    """Up to per_label rows of each label with at least `least`, by the shuffled order; null labels are left out. Pieces of large labels are thinned first."""
    ok = rows.dropna(subset=[label]).groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(label)
    key = rows.join(ok, label, "left_semi").withColumn("__h", shuffle_key(ident, seed)).withColumn("__p", F.pmod("__h", F.lit(64)))
    first = key.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__p").orderBy("__h", ident))).filter(F.col("__r") <= per_label)
    return first.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy("__h", ident))).filter(F.col("__r") <= per_label).drop("__r", "__h", "__p")
