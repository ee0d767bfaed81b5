"""Points near points and points in regions, by trapezoidal decomposition into slabs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import SALTS, hot_keys

#: Candidate pairs held at once in a task.
PAIRS_AT_ONCE = 2_000_000
#: Rows of complete tiles gathered before the kernel runs.
ROWS_AT_ONCE = 200_000
#: Side of a tile of the neighbour search, in radii, and that of the tiles a crowded one is cut into.
TILE_RADII, FINE_RADII = 32, 4


def trapezoids_of_ring(xs: np.ndarray, ys: np.ndarray, width: float) -> list[tuple[float, ...]]:
    """Trapezoids (x_left, x_right, low_left, low_right, high_left, high_right) of a simple ring.

    Elementary slabs lie between neighbouring vertex abscissae and multiples of width; within one, edges don't cross, so ordered by
    their middle they bound the inside in pairs (even-odd). Vertical edges bound no slab.
    """
    ok = np.isfinite(xs) & np.isfinite(ys)
    xs, ys = xs[ok], ys[ok]
    if len(xs) < 3:
        return []
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    cuts = np.unique(np.concatenate([xs, np.arange(np.floor(xs.min() / width) + 1, np.floor(xs.max() / width) + 1) * width]))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        mid = (a + b) / 2
        over = (np.minimum(xs, x2) < mid) & (np.maximum(xs, x2) > mid)
        p, q, r, s = xs[over], ys[over], x2[over], y2[over]
        slope = (s - q) / (r - p)
        at = lambda x: q + (x - p) * slope
        order = np.argsort(at(mid), kind="stable")
        left, right = at(a)[order], at(b)[order]
        out += [(a, b, left[k], right[k], left[k + 1], right[k + 1]) for k in range(0, len(order) - 1, 2)]
    return out


def _stab(pc: np.ndarray, y: np.ndarray, tc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (point, trapezoid) of the same code (a slab of a tile, from 0) whose y ranges meet, found by two binary searches in the slab's ordered edges."""
    codes = int(max(pc.max(initial=0), tc.max(initial=0))) + 1
    y0 = min(y.min(), lo.min())
    span = max(y.max(), hi.max()) - y0 + 1.0
    order = np.lexsort((lo, tc))
    low = tc[order] * (2 * span) + (lo[order] - y0)
    high = np.maximum.accumulate(tc[order] * (2 * span) + (hi[order] - y0))
    at_y = pc * (2 * span) + (y - y0)
    slack = 1e-9 * max(1.0, codes * 2 * span)
    start = np.searchsorted(high, at_y - slack, "left")
    stop = np.searchsorted(low, at_y + slack, "right")
    n = np.maximum(stop - start, 0)
    done = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        part = n[at:end]
        who = np.repeat(np.arange(at, end), part)
        off = np.arange(len(who)) - np.repeat(np.cumsum(part) - part, part)
        what = order[np.repeat(start[at:end], part) + off] if len(who) else np.empty(0, int)
        keep = tc[what] == pc[who]
        yield who[keep], what[keep]
        at = end


def _hits(pts: pd.DataFrame, trap: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (point, trapezoid) of the same tile whose y ranges meet."""
    code = np.unique(np.concatenate([pts["__tile"].to_numpy(), trap["__tile"].to_numpy()]), return_inverse=True)[1]
    yield from _stab(code[: len(pts)], pts["__y"].to_numpy(), code[len(pts) :], trap["__lo"].to_numpy(), trap["__hi"].to_numpy())


def disc_trapezoids(x: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, ...]:
    """Trapezoids that cover discs, in slabs of the radius' width: (disc, slab, low and high edge at the slab's left side, low and high at its right side).

    Above and below, a slab's part of the disc is bounded by the tangents at the part's middle, which lie outside the arc and slant; a disc reaches over three slabs.
    """
    own = np.floor(x / radius).astype(np.int64)
    disc = np.repeat(np.arange(len(x)), 3)
    slab = (own[:, None] + np.array([-1, 0, 1])).ravel()
    left = slab * radius
    a, b = np.maximum(left, x[disc] - radius), np.minimum(left + radius, x[disc] + radius)
    ok = b >= a  # the last slab may only be touched
    disc, slab, left, a, b = (v[ok] for v in (disc, slab, left, a, b))
    off = np.clip((a + b) / 2 - x[disc], -0.999 * radius, 0.999 * radius)
    height = np.sqrt(radius * radius - off * off)
    slope = -off / height
    at = lambda q: height + slope * (q - x[disc] - off)
    l, r = at(left), at(left + radius)
    return disc, slab, y[disc] - l, y[disc] + l, y[disc] - r, y[disc] + r


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole tiles out of a partition that is sorted by __tile, some hundred thousand rows at a time."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        rows += len(pdf)
        if rows < ROWS_AT_ONCE:
            continue
        joined = pd.concat(held, ignore_index=True)
        whole = joined["__tile"].to_numpy() != joined["__tile"].iloc[-1]
        if whole.any():
            yield joined[whole].reset_index(drop=True)
        held, rows = [joined[~whole]], 0
    if held and len(joined := pd.concat(held, ignore_index=True)):
        yield joined


def _tiled(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Tiles sorted within partitions; hot tiles have their points spread over SALTS pieces that each get all trapezoids."""
    flag = F.broadcast(hot.select("__tile", F.lit(True).alias("__hot")))
    piece = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).when(F.col("__point"), F.array(F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = rows.join(flag, "__tile", "left").withColumn("__salt", F.explode(piece)).withColumn("__tile", F.xxhash64("__tile", "__salt")).drop("__hot", "__salt")
    return spread.repartition("__tile").sortWithinPartitions("__tile")


def usable(x: str, y: str, zero_is_missing: bool = True):
    """True where (x, y) is a location: neither null, NaN nor infinite, and not the point (0, 0) unless that is allowed."""
    from math import inf

    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(F.col(x)) < inf) & (F.abs(F.col(y)) < inf)
    return ok & ~((F.col(x) == 0) & (F.col(y) == 0)) if zero_is_missing else ok


def neighbours_within(points: DataFrame, space: str, ident: str, x: str, y: str, radius: float) -> DataFrame:
    """Pairs of points of the same space (a slide) at most radius apart: columns space, a, b and distance, with a < b.

    Each point's neighbourhood is a region whose boundary is split into slabs as wide as the radius; in each it is a trapezoid (disc_trapezoids). Tiles of TILE_RADII are
    spread over the cluster, crowded ones cut into tiles of FINE_RADII, points and regions alike; in a tile, the trapezoids of a slab are ordered by their edges, and each point finds those it lies
    in by binary search between the edges of its slab; the distance is then checked exactly.
    Rows whose coordinates are null, NaN, infinite or (0, 0), or with a null space or ident, are no points; repeated rows count once; an
    ident with several positions is near another if any of them is, at the least distance. Points at one position are all paired.
    """
    w, fine = radius * TILE_RADII, radius * FINE_RADII
    src = points.filter(usable(x, y)).select(F.col(space).alias("__space"), F.col(ident).alias("__id"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna().distinct()
    at = lambda c, side: F.floor(F.col(c) / side)
    wide = radius * (1 + 1e-9)  # a neighbour at exactly the radius stays in reach despite rounding
    span = lambda c, side: (F.floor((F.col(c) - wide) / side), F.floor((F.col(c) + wide) / side))
    per = TILE_RADII // FINE_RADII
    own = src.withColumn("__sx", at("__x", w)).withColumn("__sy", at("__y", w))
    flag = F.broadcast(hot_keys(own, ["__space", "__sx", "__sy"]).withColumn("__hot", F.lit(True)))
    spread = src.withColumn("__sx", F.explode(F.sequence(*span("__x", w)))).withColumn("__sy", F.explode(F.sequence(*span("__y", w))))
    marked = lambda df: df.join(flag, ["__space", "__sx", "__sy"], "left")
    none = F.lit(-(1 << 62)).cast("bigint")
    tile = F.xxhash64("__space", "__sx", "__sy", "__fx", "__fy")
    pts = marked(own).withColumn("__fx", F.when(F.col("__hot"), at("__x", fine)).otherwise(none)).withColumn("__fy", F.when(F.col("__hot"), at("__y", fine)).otherwise(none))
    inside = lambda c, s: F.sequence(F.greatest(span(c, fine)[0], F.col(s) * per), F.least(span(c, fine)[1], F.col(s) * per + per - 1))
    discs = marked(spread).withColumn("__fx", F.explode(F.when(F.col("__hot"), inside("__x", "__sx")).otherwise(F.array(none))))
    discs = discs.withColumn("__fy", F.explode(F.when(F.col("__hot"), inside("__y", "__sy")).otherwise(F.array(none))))
    shown = lambda df, point: df.select(tile.alias("__tile"), "__space", "__id", "__x", "__y", F.lit(point).alias("__point"))
    pts = shown(pts, True)
    kind = dict(src.dtypes)
    rows = _tiled(pts.unionByName(shown(discs, False)), hot_keys(pts, ["__tile"]))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _tiles(batches):
            point = pdf["__point"].to_numpy()
            p, t = pdf[point], pdf[~point]
            if not len(p) or not len(t):
                continue
            px, py, tx, ty = p["__x"].to_numpy(), p["__y"].to_numpy(), t["__x"].to_numpy(), t["__y"].to_numpy()
            pid, tid, psp, tsp = p["__id"].to_numpy(), t["__id"].to_numpy(), p["__space"].to_numpy(), t["__space"].to_numpy()
            disc, slab, ll, lh, rl, rh = disc_trapezoids(tx, ty, wide)
            tiles = np.unique(pdf["__tile"].to_numpy(), return_inverse=True)[1]
            pt, tt = tiles[point], tiles[~point][disc]
            mine = np.floor(px / wide).astype(np.int64)
            codes = np.unique(np.concatenate([np.stack([pt, mine], 1), np.stack([tt, slab], 1)]), axis=0, return_inverse=True)[1].ravel()
            for i, k in _stab(codes[: len(pt)], py, codes[len(pt) :], np.minimum(ll, rl), np.maximum(lh, rh)):
                j = disc[k]
                d = np.hypot(px[i] - tx[j], py[i] - ty[j])
                ok = (d <= radius) & (pid[i] < tid[j])
                i, j, d = i[ok], j[ok], d[ok]
                same = psp[i] == tsp[j]
                yield pd.DataFrame({"space": psp[i][same], "a": pid[i][same], "b": tid[j][same], "distance": d[same]})

    found = rows.mapInPandas(locate, f"space {kind['__space']}, a {kind['__id']}, b {kind['__id']}, distance double")
    return found.groupBy("space", "a", "b").agg(F.min("distance").alias("distance"))


def locate_in_regions(points: DataFrame, regions: DataFrame, space: str, ident: str, x: str, y: str, region: str, ring: str, width: float) -> DataFrame:
    """Regions that contain each point: columns space, id, region; a point in several regions gives a row for each, one in none gives none.

    regions has columns space, region and ring (array of struct<x, y>, simple, closed or not; several rings of a region are its parts).
    Boundaries are split into trapezoids per slab of the given width, slabs are spread over the cluster in blocks as high as wide, and
    points find the trapezoids above and below them by binary search. Points on a lower or left boundary count as inside, on an upper or
    right one not, so regions that share a wall never both hold a point. Null, NaN and infinite coordinates, null ids and rings of fewer than
    three points match nothing.
    """
    src = points.filter(usable(x, y, zero_is_missing=False)).select(F.col(space).alias("__space"), F.col(ident).cast("string").alias("__id"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna()
    kind, rkind = dict(src.dtypes), "string"  # ids travel as text: a column of longs with nulls would lose digits in pandas
    types = (dict(points.dtypes)[ident], dict(regions.dtypes)[region])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, r, points_ in zip(pdf["__space"], pdf["__region"], pdf["__ring"]):
                if points_ is None:
                    continue
                v = np.array([(np.nan if q["x"] is None else q["x"], np.nan if q["y"] is None else q["y"]) for q in points_], float).reshape(-1, 2)
                out += [(s, r, *t) for t in trapezoids_of_ring(v[:, 0], v[:, 1], width)]
            yield pd.DataFrame(out, columns=["__space", "__region", "__xl", "__xr", "__ll", "__lr", "__hl", "__hr"])

    cut = regions.select(F.col(space).alias("__space"), F.col(region).cast("string").alias("__region"), F.col(ring).alias("__ring")).dropna(subset=["__space", "__region"])
    geo = ["__xl", "__xr", "__ll", "__lr", "__hl", "__hr"]
    trap = cut.mapInPandas(split, f"__space {kind['__space']}, __region {rkind}, " + ", ".join(f"{g} double" for g in geo))
    tile = F.xxhash64("__space", "__sx", "__sy")
    trap = trap.withColumns({"__sx": F.floor((F.col("__xl") + F.col("__xr")) / 2 / width), "__lo": F.least("__ll", "__lr"), "__hi": F.greatest("__hl", "__hr")})
    trap = trap.withColumn("__sy", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    none = [F.lit(None).cast("double").alias(g) for g in geo]
    trap = trap.select(tile.alias("__tile"), "__space", F.lit(None).cast("string").alias("__id"), "__region", F.lit(None).cast("double").alias("__x"), F.col("__lo").alias("__y"), "__lo", "__hi", *geo, F.lit(False).alias("__point"))
    pts = src.select("*", F.floor(F.col("__x") / width).alias("__sx"), F.floor(F.col("__y") / width).alias("__sy")).select(tile.alias("__tile"), "__space", "__id", F.lit(None).cast(rkind).alias("__region"), "__x", "__y", F.col("__y").alias("__lo"), F.col("__y").alias("__hi"), *none, F.lit(True).alias("__point"))
    rows = _tiled(pts.unionByName(trap), hot_keys(pts, ["__tile"]))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _tiles(batches):
            point = pdf["__point"].to_numpy()
            p, t = pdf[point].reset_index(drop=True), pdf[~point].reset_index(drop=True)
            if not len(p) or not len(t):
                continue
            for i, j in _hits(p, t):
                q, z = p.iloc[i], t.iloc[j]
                px, py = q["__x"].to_numpy(), q["__y"].to_numpy()
                xl, xr = z["__xl"].to_numpy(), z["__xr"].to_numpy()
                part = (px - xl) / (xr - xl)
                low = z["__ll"].to_numpy() + part * (z["__lr"] - z["__ll"]).to_numpy()
                high = z["__hl"].to_numpy() + part * (z["__hr"] - z["__hl"]).to_numpy()
                ok = (px >= xl) & (px < xr) & (py >= low) & (py < high) & (q["__space"].to_numpy() == z["__space"].to_numpy())
                yield pd.DataFrame({"space": q["__space"].to_numpy()[ok], "id": q["__id"].to_numpy()[ok], "region": z["__region"].to_numpy()[ok]})

    return rows.mapInPandas(locate, f"space {kind['__space']}, id string, region string").distinct().select("space", F.col("id").cast(types[0]).alias("id"), F.col("region").cast(types[1]).alias("region"))
