"""Cell graphs: construction, directed view, degrees, smoothing weights, composition, pruning and rings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Radius that clips Voronoi regions, longest edge of the model's graph and decay of the smoothing weights, in µm.
CLIP_UM, MODEL_EDGE_UM, DECAY_UM = 30.0, 40.0, 20.0
#: Side of a tile of the Voronoi kernel, in clip radii.
TILE_RADII = 8


#: Neighbours with which a region is first solved, points to a bin of the search for them, and points solved at once.
FIRST_NEIGHBOURS, BIN_POINTS, POINTS_AT_ONCE = 24, 6, 512


def _faces(dx: np.ndarray, dy: np.ndarray, clip: float) -> tuple[np.ndarray, np.ndarray]:
    """Of points (rows) with neighbours at (dx, dy) (inf: none): the length of each face of the disc-clipped region (0: none) and how far the region reaches.

    On the bisector of a point and a neighbour at D a third one at E rules out t * (n.E) > (|E|^2 - D.E) / 2; what is left between the bounds and the disc is the face.
    """
    r2 = dx * dx + dy * dy
    real = np.isfinite(r2)
    dx, dy, r2 = np.where(real, dx, 0.0), np.where(real, dy, 0.0), np.where(real, r2, 1.0)
    d = np.sqrt(r2)
    nx, ny = -dy / d, dx / d
    rhs = (r2[:, None, :] - (dx[:, :, None] * dx[:, None, :] + dy[:, :, None] * dy[:, None, :])) / 2
    ne = nx[:, :, None] * dx[:, None, :] + ny[:, :, None] * dy[:, None, :]
    other = real[:, None, :] & ~np.eye(dx.shape[1], dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = rhs / ne
    hi = np.where(other & (ne > 0), t, np.inf).min(axis=2)
    lo = np.where(other & (ne < 0), t, -np.inf).max(axis=2)
    dead = (other & (ne == 0) & (rhs < 0)).any(axis=2)
    h = np.sqrt(np.maximum(clip * clip - r2 / 4, 0))
    top, low = np.minimum(hi, h), np.maximum(lo, -h)
    face = np.where(real & ~dead, np.maximum(top - low, 0), 0)
    ends = np.where(face > 0, np.maximum(np.abs(top), np.abs(low)), 0)
    corner = np.where(face > 0, np.sqrt(r2 / 4 + ends * ends), 0).max(axis=1, initial=0)
    # Where two faces don't meet, the disc itself bounds the region.
    open_ = (np.where(face > 0, (hi > h) | (lo < -h), False)).any(axis=1) | (face > 0).sum(axis=1).__lt__(3)
    return face, np.where(open_, clip, np.minimum(corner, clip))


def voronoi_faces(x: np.ndarray, y: np.ndarray, own: np.ndarray, clip: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, face) for own points i: lengths of the faces of disc-clipped Voronoi regions.

    A region that reaches R far is bounded by points within 2 R alone, so each is solved with its FIRST_NEIGHBOURS nearest points, found in bins, and again with all within two radii of
    the clipping disc only where that doesn't prove it whole.
    """
    mine = np.flatnonzero(own)
    none = np.empty(0, int), np.empty(0, int), np.empty(0)
    if not len(mine) or len(x) < 2:
        return none
    x0, y0 = x.min(), y.min()
    side = max(np.sqrt(max(np.ptp(x), 1e-9) * max(np.ptp(y), 1e-9) * BIN_POINTS / len(x)), max(np.ptp(x), np.ptp(y)) / 2000, 1e-9)
    bx, by = ((x - x0) // side).astype(np.int64) + 2, ((y - y0) // side).astype(np.int64) + 2
    wide = int(bx.max()) + 3
    order = np.argsort(by * wide + bx, kind="stable")
    code = (by * wide + bx)[order]
    by_x = np.argsort(x, kind="stable")
    sorted_x = x[by_x]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    again: list[np.ndarray] = []
    for at in range(0, len(mine), POINTS_AT_ONCE):
        p = mine[at : at + POINTS_AT_ONCE]
        start = np.searchsorted(code, (by[p][:, None] + np.arange(-2, 3)) * wide + bx[p][:, None] - 2, "left")
        stop = np.searchsorted(code, (by[p][:, None] + np.arange(-2, 3)) * wide + bx[p][:, None] + 2, "right")
        n = stop - start
        each = n.sum(axis=1)
        first = np.concatenate([[0], each.cumsum()[:-1]])
        flat = np.arange(each.sum()) - np.repeat(n.ravel().cumsum() - n.ravel(), n.ravel()) + np.repeat(start.ravel(), n.ravel())
        row = np.repeat(np.arange(len(p)), each)
        near = np.full((len(p), int(each.max())), -1)
        near[row, np.arange(each.sum()) - first[row]] = order[flat]
        dx, dy = x[near] - x[p][:, None], y[near] - y[p][:, None]
        r2 = np.where((near >= 0) & (near != p[:, None]), dx * dx + dy * dy, np.inf)
        r2 = np.where((r2 == 0) | (r2 > 4 * clip * clip), np.inf, r2)
        k = min(FIRST_NEIGHBOURS, r2.shape[1])
        best = np.argpartition(r2, k - 1, axis=1)[:, :k]
        take = lambda a: np.take_along_axis(a, best, 1)
        some = np.isfinite(take(r2))
        face, reach = _faces(np.where(some, take(dx), np.inf), np.where(some, take(dy), np.inf), clip)
        left = np.sqrt(np.where(some.all(axis=1), np.where(some, take(r2), 0).max(axis=1), np.inf))  # nearer points are all among the chosen
        whole = 2 * reach <= np.minimum(left, 2 * side)
        a, b = np.nonzero((face > 1e-9) & whole[:, None])
        out.append((p[a], take(near)[a, b], face[a, b]))
        again.append(p[~whole])
    for i in np.concatenate(again):
        near = by_x[np.searchsorted(sorted_x, x[i] - 2 * clip, "left") : np.searchsorted(sorted_x, x[i] + 2 * clip, "right")]
        dx, dy = x[near] - x[i], y[near] - y[i]
        r2 = dx * dx + dy * dy
        keep = (r2 > 0) & (r2 <= 4 * clip * clip)
        near, dx, dy, r2 = near[keep], dx[keep], dy[keep], r2[keep]
        if not len(near):
            continue
        nearest_first = np.argsort(r2, kind="stable")
        for k in (64, len(near)):  # the nearest ones prove most regions whole here as well
            part = nearest_first[:k]
            face, reach = _faces(dx[None, part], dy[None, part], clip)
            if k >= len(near) or 2 * reach[0] <= np.sqrt(r2[nearest_first[k]]):
                break
        ok = face[0] > 1e-9
        out.append((np.full(ok.sum(), i), near[part[ok]], face[0][ok]))
    i, j, f = (np.concatenate(v) for v in zip(*out)) if out else none
    return i, j, f


def voronoi_edges(points: DataFrame, space: str, ident: str, x: str, y: str, clip: float = CLIP_UM) -> DataFrame:
    """space, i, j (i < j), face, distance of each pair of points whose clipped Voronoi regions share a face.

    Points are copied to the tiles within two clip radii of them, so each tile solves its own points alone and one shuffle does. Of points
    at one place only the one with the least ident takes part; null, NaN and infinite coordinates take none.
    """
    side = clip * TILE_RADII
    fine = ~F.isnan(x) & ~F.isnan(y) & (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))
    src = points.filter(fine).groupBy(F.col(space).alias("space"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.min(ident).alias("id")).dropna()
    over = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 2 * clip) / side), F.floor((F.col(c) + 2 * clip) / side)))
    tiled = src.withColumn("tx", over("x")).withColumn("ty", over("y")).withColumn("own", (F.floor(F.col("x") / side) == F.col("tx")) & (F.floor(F.col("y") / side) == F.col("ty")))
    kind = dict(src.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, f = voronoi_faces(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["own"].to_numpy(), clip)
        ids, px, py = pdf["id"].to_numpy(), pdf["x"].to_numpy(), pdf["y"].to_numpy()
        ok = ids[i] < ids[j]
        i, j, f = i[ok], j[ok], f[ok]
        return pd.DataFrame({"space": pdf["space"].to_numpy()[i], "i": ids[i], "j": ids[j], "face": f, "distance": np.hypot(px[i] - px[j], py[i] - py[j])})

    return tiled.groupBy("space", "tx", "ty").applyInPandas(solve, f"space {kind['space']}, i {kind['id']}, j {kind['id']}, face double, distance double")


def directed(edges: DataFrame, keep: list[str]) -> DataFrame:
    """dst, src, into_j and the kept columns: each undirected edge i < j in both directions, in one pass."""
    ends = F.explode(F.array(F.struct(F.col("j").alias("dst"), F.col("i").alias("src"), F.lit(True).alias("into_j")), F.struct(F.col("i").alias("dst"), F.col("j").alias("src"), F.lit(False).alias("into_j"))))
    return edges.select(ends.alias("__e"), *keep).select("__e.*", *keep)


def degrees(cells: DataFrame, ident: str, edges: DataFrame) -> DataFrame:
    """ident, degree: incident edges of every cell, 0 for isolated ones."""
    n = directed(edges, []).groupBy(F.col("dst").alias(ident)).agg(F.count(F.lit(1)).alias("degree"))
    return cells.select(ident).distinct().join(n, ident, "left").select(ident, F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def graph_summary(degree: DataFrame, edges: DataFrame, graph: str, wall: str) -> DataFrame:
    """graph, n_edges, mean_degree, isolated_fraction (both over all cells) and the median wall; degree: graph, degree; edges: graph, i, wall. Graphs are few."""
    from .batching import exact_median

    cells = degree.groupBy(graph).agg(F.avg("degree").alias("mean_degree"), F.avg((F.col("degree") == 0).cast("double")).alias("isolated_fraction"))
    walls = edges.groupBy(graph).agg(F.count(F.lit(1)).alias("n_edges"))
    names = [r[0] for r in walls.select(graph).collect()]
    medians = [(k, exact_median(edges.filter(F.col(graph) == k), wall, "i")) for k in names]
    middle = edges.sparkSession.createDataFrame(medians, f"{graph} string, median_wall_um double")
    return cells.join(walls, graph, "left").join(middle, graph, "left").select(graph, F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "mean_degree", "isolated_fraction", "median_wall_um")


def graph_statistics(degree: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """graph, n_edges, mean_degree, median_degree (whole), isolated_percent, median_centroid_um, median_gap_um and touching_percent (edges with a gap of zero) of each variant of a graph.

    degree: graph, cell_ix, degree; edges: graph, i, centroid_dist_um, wall_dist_um. Variants are few.
    """
    from .batching import value_at_rank, exact_median

    out = []
    for k in [r[0] for r in degree.select(graph).distinct().collect()]:
        d, e = degree.filter(F.col(graph) == k), edges.filter(F.col(graph) == k)
        mid = [r[0] for up in (False, True) for r in value_at_rank(d, "degree", "cell_ix", 0.5, up).select("degree").collect()]
        out.append((k, int(sum(mid) / 2) if mid else None, exact_median(e, "centroid_dist_um", "i"), exact_median(e, "wall_dist_um", "i")))
    medians = degree.sparkSession.createDataFrame(out, f"{graph} string, median_degree int, median_centroid_um double, median_gap_um double")
    cells = degree.groupBy(graph).agg(F.avg("degree").alias("mean_degree"), (F.avg((F.col("degree") == 0).cast("double")) * 100).alias("isolated_percent"))
    sums = edges.groupBy(graph).agg(F.count(F.lit(1)).alias("n_edges"), (F.avg(F.coalesce(F.col("wall_dist_um") == 0, F.lit(False)).cast("double")) * 100).alias("touching_percent"))
    return cells.join(sums, graph, "left").join(medians, graph).withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def graph_variants(graphs: dict[str, DataFrame]) -> DataFrame:
    """All variants of a graph in one frame, told apart by the column graph; columns that one lacks are null."""
    parts = [df.withColumn("graph", F.lit(name)) for name, df in graphs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def isolation_counts(cells: DataFrame, ident: str, kept: DataFrame, lost: DataFrame) -> DataFrame:
    """One row: n_isolated and n_single (cells with no edge and with one in kept), most_lost (the most edges one cell lost in pruning; 0 without). lost: as from prune()."""
    n = degrees(cells, ident, kept).agg(F.count_if(F.col("degree") == 0).alias("n_isolated"), F.count_if(F.col("degree") == 1).alias("n_single"))
    return n.crossJoin(lost.agg(F.coalesce(F.max("n_pruned"), F.lit(0)).alias("most_lost")))  # one row each


def smoothing_weights(edges: DataFrame, face: str, distance: str, decay: float | None = DECAY_UM) -> DataFrame:
    """dst, src, into_j, beta: face * exp(-distance / decay) over its sum at dst; all zero where the sum is. Isolated cells have no row; without a decay distance doesn't count.

    Null faces count as zero, null distances as no decay.
    """
    near = F.exp(-F.coalesce(F.col(distance), F.lit(0.0)) / decay) if decay else F.lit(1.0)
    rows = directed(edges.withColumn("__raw", F.coalesce(F.col(face), F.lit(0.0)) * near), ["__raw"])
    total = F.sum("__raw").over(Window.partitionBy("dst"))
    return rows.select("dst", "src", "into_j", (F.col("__raw") / F.greatest(total, F.lit(1e-12))).alias("beta"))


def niche(edges: DataFrame, types: DataFrame, ident: str, kind: str) -> DataFrame:
    """dst, type, share: share of each neighbour type of a connected cell (types of share zero have no row)."""
    rows = directed(edges, []).join(types.select(F.col(ident).alias("src"), F.col(kind).alias("type")), "src")
    counts = rows.groupBy("dst", "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("dst", "type", (F.col("n") / F.sum("n").over(Window.partitionBy("dst"))).alias("share"))


def composition(niches: DataFrame, types: DataFrame, ident: str, kind: str) -> DataFrame:
    """type, neighbour_type, share, support: the mean niche of the connected cells of a type (not of pooled edges), and their number."""
    own = types.select(F.col(ident).alias("dst"), F.col(kind).alias("own"))
    rows = niches.join(own, "dst")
    support = niches.select("dst").distinct().join(own, "dst").groupBy("own").agg(F.count(F.lit(1)).alias("support"))
    sums = rows.groupBy("own", "type").agg(F.sum("share").alias("s"))
    return sums.join(support, "own").select(F.col("own").alias("type"), F.col("type").alias("neighbour_type"), (F.col("s") / F.col("support")).alias("share"), "support")


def prune(edges: DataFrame, distance: str, longest: float = MODEL_EDGE_UM) -> tuple[DataFrame, DataFrame]:
    """(kept edges, per cell the number it lost): an edge is kept if its distance is known and at most longest."""
    ok = F.coalesce(F.col(distance) <= longest, F.lit(False))
    lost = directed(edges.filter(~ok), []).groupBy("dst").agg(F.count(F.lit(1)).alias("n_pruned"))
    return edges.filter(ok), lost


def filter_edges(edges: DataFrame, max_gap: float | None = None, min_wall: float | None = None, max_centroid: float | None = None, min_apposed: float | None = None) -> DataFrame:
    """Edges within all given bounds (inclusive); a bound on a column that edges lacks is ignored, a null value fails its bound."""
    for col, bound, above in (("wall_dist_um", max_gap, False), ("shared_wall_um", min_wall, True), ("centroid_dist_um", max_centroid, False), ("apposed_wall_um", min_apposed, True)):
        if bound is not None and col in edges.columns:
            edges = edges.filter(F.col(col) >= bound if above else F.col(col) <= bound)
    return edges


def within_window(cells: DataFrame, edges: DataFrame, ident: str, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Edges with both ends in the closed box (x0, y0, x1, y1)."""
    inside = cells.filter(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])).select(ident).distinct()
    return edges.join(inside.withColumnRenamed(ident, "i"), "i", "left_semi").join(inside.withColumnRenamed(ident, "j"), "j", "left_semi")


def rings(edges: DataFrame, seeds: DataFrame, group: str, ident: str) -> DataFrame:
    """group, id, ring (0 seeds, 1, 2): cells one and two hops from each group's seeds, disjoint."""
    both = directed(edges, []).select("dst", "src")
    zero = seeds.select(F.col(group).alias("g"), F.col(ident).alias("id")).dropna().distinct()
    hop = lambda df: df.join(both, df["id"] == both["dst"]).select("g", F.col("src").alias("id"))
    rows = zero.withColumn("ring", F.lit(0)).unionByName(hop(zero).distinct().withColumn("ring", F.lit(1)))
    upto1 = rows.groupBy("g", "id").agg(F.min("ring").alias("ring"))
    rows = upto1.unionByName(hop(upto1.filter("ring = 1").select("g", "id")).distinct().withColumn("ring", F.lit(2)))
    return rows.groupBy("g", "id").agg(F.min("ring").alias("ring")).select(F.col("g").alias(group), "id", "ring")


def segment_softmax(keys: list[str], score: str) -> Column:
    """Softmax of score within keys, shifted by the maximum; a window, so every key's rows sum to one."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)
