"""Geometry of cell outlines: numpy kernels on rings (open or closed vertex lists) and Arrow-batched columns over them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ring(xs, ys) -> np.ndarray | None:
    """Vertices as an open ring without nulls, NaN and repeated neighbours; None with fewer than three."""
    if xs is None or ys is None:
        return None
    v = np.array([xs, ys], dtype=float).T if len(xs) == len(ys) else np.empty((0, 2))
    v = v[np.isfinite(v).all(axis=1)]
    if len(v):
        v = v[(v != np.roll(v, -1, axis=0)).any(axis=1)] if len(v) > 1 else v
    return v if len(v) >= 3 else None


def area(v: np.ndarray) -> float:
    x, y = v[:, 0] - v[0, 0], v[:, 1] - v[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def perimeter(v: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(v, -1, axis=0) - v).T).sum())


def centroid(v: np.ndarray) -> tuple[float, float]:
    """Centre of area; the mean vertex of a flat ring."""
    o = v[0]
    x, y = (v - o).T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    a = cross.sum() / 2
    if abs(a) < 1e-12:
        return tuple(map(float, v.mean(axis=0)))
    return float(o[0] + ((x + np.roll(x, -1)) * cross).sum() / (6 * a)), float(o[1] + ((y + np.roll(y, -1)) * cross).sum() / (6 * a))


def hull(v: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by the monotone chain."""
    p = np.unique(v, axis=0)
    if len(p) < 3:
        return p

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def contains(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd test of points."""
    x, y = np.asarray(x, float)[..., None], np.asarray(y, float)[..., None]
    (x1, y1), (x2, y2) = v.T, np.roll(v, -1, axis=0).T
    over = (y1 > y) != (y2 > y)
    rise = np.where(y2 == y1, 1.0, y2 - y1)
    return ((over & (x < (x2 - x1) * (y - y1) / rise + x1)).sum(axis=-1) % 2).astype(bool)


def representative_point(v: np.ndarray) -> tuple[float, float]:
    """A point inside: the middle of the widest stretch of the horizontal line halfway between two vertex heights near the middle."""
    heights = np.unique(v[:, 1])
    if len(heights) < 2:
        return tuple(map(float, v.mean(axis=0)))
    k = int(np.clip(np.searchsorted(heights, (heights[0] + heights[-1]) / 2), 1, len(heights) - 1))
    y = (heights[k - 1] + heights[k]) / 2
    w = np.roll(v, -1, axis=0)
    over = (v[:, 1] > y) != (w[:, 1] > y)
    xs = np.sort(v[over, 0] + (y - v[over, 1]) / (w[over, 1] - v[over, 1]) * (w[over, 0] - v[over, 0]))
    wide = xs[1::2] - xs[::2]
    at = int(wide.argmax())
    return float((xs[2 * at] + xs[2 * at + 1]) / 2), float(y)


def measures(v: np.ndarray, scale: float) -> tuple[float, ...]:
    """area, perimeter, centre x and y (unscaled), hull area, circularity, solidity and equivalent diameter; lengths times scale."""
    a, p, h = abs(area(v)) * scale**2, perimeter(v) * scale, abs(area(w)) * scale**2 if len(w := hull(v)) > 2 else 0.0
    return (a, p, *centroid(v), h, 4 * np.pi * a / p**2 if p else 0.0, a / h if h else 0.0, 2 * np.sqrt(max(a, 0) / np.pi))


def _segments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v, np.roll(v, -1, axis=0)


def _point_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points p (n x 2) from segments a-b (m): n x m."""
    d = b - a
    t = np.clip(((p[:, None, :] - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    return np.hypot(*np.moveaxis(p[:, None, :] - (a + t[..., None] * d), -1, 0))


def _crossing(v: np.ndarray, w: np.ndarray) -> bool:
    a, b = _segments(v)
    c, d = _segments(w)
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    a, b, c, d = a[:, None], b[:, None], c[None], d[None]
    return bool(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any())


def distance(v: np.ndarray, w: np.ndarray) -> float:
    """Least distance of two regions; 0 if they overlap."""
    if _crossing(v, w) or contains(v, w[:1, 0], w[:1, 1])[0] or contains(w, v[:1, 0], v[:1, 1])[0]:
        return 0.0
    return float(min(_point_segment(v, *_segments(w)).min(), _point_segment(w, *_segments(v)).min()))


#: Numbers held at once when many pairs of outlines are compared.
PAIR_NUMBERS = 2_000_000


def distances(vs: list[np.ndarray | None], ws: list[np.ndarray | None]) -> np.ndarray:
    """distance() of each pair; pairs of equal numbers of vertices are solved together. NaN where an outline is missing."""
    out = np.full(len(vs), np.nan)
    sizes = np.array([(len(v), len(w)) if v is not None and w is not None else (0, 0) for v, w in zip(vs, ws)], int).reshape(-1, 2)
    for n, m in np.unique(sizes[sizes[:, 0] > 0], axis=0):
        which = np.flatnonzero((sizes[:, 0] == n) & (sizes[:, 1] == m))
        step = max(1, PAIR_NUMBERS // (n * m))
        for at in range(0, len(which), step):
            part = which[at : at + step]
            out[part] = _distances(np.stack([vs[k] for k in part]), np.stack([ws[k] for k in part]))
    return out


def _distances(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least distances of pairs of regions (pairs x vertices x 2), 0 where they overlap."""
    near = np.minimum(_vertex_side(v, w), _vertex_side(w, v))
    a, b, c, d = v[:, :, None], np.roll(v, -1, axis=1)[:, :, None], w[:, None], np.roll(w, -1, axis=1)[:, None]
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    crossing = ((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any(axis=(1, 2))
    return np.where(crossing | _holds(v, w[:, 0]) | _holds(w, v[:, 0]), 0.0, near)


def _vertex_side(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least distance of a vertex of v from a side of w, by pair."""
    a, d = w[:, None], (np.roll(w, -1, axis=1) - w)[:, None]
    off = v[:, :, None] - a
    t = np.clip((off * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    return np.sqrt((off[..., 0] - t * d[..., 0]) ** 2 + (off[..., 1] - t * d[..., 1]) ** 2).min(axis=(1, 2))


def _holds(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each region holds its point, by the parity of the sides to its right."""
    a, b = v, np.roll(v, -1, axis=1)
    x, y = p[:, :1], p[:, 1:]
    over = (a[..., 1] > y) != (b[..., 1] > y)
    with np.errstate(all="ignore"):
        right = x < a[..., 0] + (y - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1])
    return ((over & right).sum(axis=1) % 2).astype(bool)


def _union(spans: np.ndarray) -> float:
    """Length of the union of intervals (rows: start, end)."""
    spans = spans[spans[:, 1] > spans[:, 0]]
    if not len(spans):
        return 0.0
    spans = spans[np.argsort(spans[:, 0])]
    reach = np.maximum.accumulate(spans[:, 1])
    before = np.concatenate([[-np.inf], reach[:-1]])
    return float(np.maximum(reach - np.maximum(spans[:, 0], before), 0).sum())


def _covered(v: np.ndarray, w: np.ndarray, reach: float) -> float:
    """Length of v's boundary within reach of w's region: the union, side by side of v, of the stretches within reach of w's sides and of those inside w."""
    p, q = _segments(v)
    a, b = _segments(w)
    length = np.hypot(*(q - p).T)
    ok = length > 0
    p, q, length = p[ok], q[ok], length[ok]
    if not len(p):
        return 0.0
    u = (q - p) / length[:, None]
    lo, hi = _capsules(p[:, None], u[:, None], length[:, None], a[None], b[None], reach)
    # Where a side crosses w's boundary it may pass into w or out of it; what lies between two crossings is wholly inside or outside.
    d, r = (b - a)[None], a[None] - p[:, None]
    det = u[:, None, 0] * d[..., 1] - u[:, None, 1] * d[..., 0]
    with np.errstate(all="ignore"):
        t, s = (r[..., 0] * d[..., 1] - r[..., 1] * d[..., 0]) / det, (r[..., 0] * u[:, None, 1] - r[..., 1] * u[:, None, 0]) / det
    on = (np.abs(det) > 1e-15) & (t > 0) & (t < length[:, None]) & (s >= 0) & (s <= 1)
    cuts = np.sort(np.concatenate([np.zeros((len(p), 1)), np.where(on, t, length[:, None]), length[:, None]], 1), 1)
    mid = (cuts[:, :-1] + cuts[:, 1:]) / 2
    inside = contains(w, p[:, :1] + mid * u[:, :1], p[:, 1:] + mid * u[:, 1:])
    starts, ends = np.concatenate([lo, np.where(inside, cuts[:, :-1], 0)], 1), np.concatenate([hi, np.where(inside, cuts[:, 1:], 0)], 1)
    shift = (np.arange(len(p)) * 2 * length.max())[:, None]  # sides next to, never over, each other
    good = ends > starts
    return _union(np.stack([(starts + shift)[good], (ends + shift)[good]], 1))


def _capsules(p: np.ndarray, u: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of the line p + t u, 0 <= t <= length, within r of each segment a-b: one interval each, as a capsule is convex (start above end: none)."""
    dot = lambda x, y: x[..., 0] * y[..., 0] + x[..., 1] * y[..., 1]
    lo, hi = np.inf, -np.inf
    for c in (a, b):  # the discs about the ends
        off = c - p
        t0 = dot(off, u)
        h2 = r * r - dot(off, off) + t0 * t0
        h = np.sqrt(np.maximum(h2, 0))
        lo, hi = np.where(h2 >= 0, np.minimum(lo, t0 - h), lo), np.where(h2 >= 0, np.maximum(hi, t0 + h), hi)
    d = b - a
    n2 = np.maximum(dot(d, d), 1e-300)
    n = np.stack([-d[..., 1], d[..., 0]], -1) / np.sqrt(n2)[..., None]
    s, e = -np.inf, np.inf
    for k, c, m in ((dot(n, u), dot(p - a, n), r), (dot(d, u) / n2, dot(p - a, d) / n2 - 0.5, 0.5)):  # the strip between them
        flat = np.abs(k) < 1e-15
        with np.errstate(all="ignore"):
            x, y = (-m - c) / k, (m - c) / k
        s = np.maximum(s, np.where(flat, np.where(np.abs(c) > m, np.inf, -np.inf), np.minimum(x, y)))
        e = np.minimum(e, np.where(flat, np.inf, np.maximum(x, y)))
    ok = s <= e
    lo, hi = np.where(ok, np.minimum(lo, s), lo), np.where(ok, np.maximum(hi, e), hi)
    return np.maximum(lo, 0.0), np.minimum(hi, length)


def apposed_wall(v: np.ndarray, w: np.ndarray, reach: float) -> float:
    """Mean length of either boundary that lies within reach of the other region."""
    return (_covered(v, w, reach) + _covered(w, v, reach)) / 2


def shared_boundary(v: np.ndarray, w: np.ndarray, slack: float = 1e-6) -> float:
    """Length of the boundary two touching outlines have in common (within slack); 0 if they don't touch."""
    a, b = _segments(w)
    total = 0.0
    for p, q in zip(*_segments(v)):
        length = float(np.hypot(*(q - p)))
        if not length:
            continue
        u = (q - p) / length
        off = np.maximum(*(np.abs(u[0] * (c - p)[:, 1] - u[1] * (c - p)[:, 0]) for c in (a, b)))
        s, e = (a - p) @ u, (b - p) @ u
        total += _union(np.stack([np.clip(np.minimum(s, e), 0, length), np.clip(np.maximum(s, e), 0, length)], 1)[off <= slack])
    return total


def simple_part(v: np.ndarray) -> np.ndarray | None:
    """The ring itself if no two of its sides cross, else the largest loop left by cutting it at its crossings; None if nothing with an area is left."""
    n = len(v)
    if n < 3:
        return None
    for i in range(n):
        a, b = v[i], v[(i + 1) % n]
        for j in range(i + 2, n - (i == 0)):
            c, d = v[j], v[(j + 1) % n]
            det = (b - a)[0] * (d - c)[1] - (b - a)[1] * (d - c)[0]
            if abs(det) < 1e-15:
                continue
            t = ((c - a)[0] * (d - c)[1] - (c - a)[1] * (d - c)[0]) / det
            s = ((c - a)[0] * (b - a)[1] - (c - a)[1] * (b - a)[0]) / det
            if 1e-12 < t < 1 - 1e-12 and 1e-12 < s < 1 - 1e-12:
                at = a + t * (b - a)
                parts = [simple_part(np.vstack([at, v[i + 1 : j + 1]])), simple_part(np.vstack([at, v[j + 1 :], v[: i + 1]]))]
                parts = [p for p in parts if p is not None]
                return max(parts, key=lambda p: abs(area(p)), default=None)
    return v if abs(area(v)) > 1e-12 else None


def to_wkb(v: np.ndarray) -> bytes:
    """Well-known binary of a polygon with one closed ring, little-endian."""
    closed = np.vstack([v, v[:1]])
    return struct.pack("<BIII", 1, 3, 1, len(closed)) + closed.astype("<f8").tobytes()


def from_wkb(data: bytes | None) -> np.ndarray | None:
    """Outer ring of a polygon; None for anything else."""
    if not data or len(data) < 13:
        return None
    e = "<" if data[0] == 1 else ">"
    kind, rings, n = struct.unpack(f"{e}III", data[1:13])
    if kind != 3 or rings < 1 or len(data) < 13 + 16 * n:
        return None
    v = np.frombuffer(data, f"{e}f8", 2 * n, 13).reshape(-1, 2).astype(float)
    return ring(v[:, 0], v[:, 1])


def disk_mask(size: int, radius: float, field: float) -> np.ndarray:
    """True outside the disc of radius (in units of field) about the middle of a size x size window."""
    at = (np.arange(size) - (size - 1) / 2) * field / size
    return at[:, None] ** 2 + at[None, :] ** 2 > radius**2


def polygon_mask(v: np.ndarray, width: int, height: int) -> np.ndarray:
    """True for pixels whose centre lies in the ring, or that the outline passes through."""
    y, x = np.mgrid[0:height, 0:width]
    mask = contains(v, x.astype(float).ravel(), y.astype(float).ravel()).reshape(height, width)
    for a, b in zip(*_segments(v)):
        n = int(np.ceil(np.abs(b - a).max())) + 1
        px, py = np.rint(np.linspace(a, b, n + 1)).astype(int).T
        ok = (px >= 0) & (px < width) & (py >= 0) & (py < height)
        mask[py[ok], px[ok]] = True
    return mask


_MEASURES = ("area_um2", "perimeter_um", "centroid_x", "centroid_y", "hull_area_um2", "circularity", "solidity", "equiv_diameter_um")


@F.pandas_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in _MEASURES]))
def _measured(xs: pd.Series, ys: pd.Series, scale: pd.Series) -> pd.DataFrame:
    rows = [measures(v, s) if (v := ring(x, y)) is not None and s == s else (None,) * len(_MEASURES) for x, y, s in zip(xs, ys, scale)]
    return pd.DataFrame(rows, columns=list(_MEASURES), dtype=float)


def polygon_metrics(xs: str | Column, ys: str | Column, scale: str | Column) -> Column:
    """Struct of an outline's measures (xs, ys: arrays in pixels; scale: µm a pixel); nulls for outlines of fewer than three vertices."""
    return _measured(xs, ys, scale)


@F.pandas_udf(T.DoubleType())
def outline_distance(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series(distances([ring(a, b) for a, b in zip(ax, ay)], [ring(c, d) for c, d in zip(bx, by)]))


@F.pandas_udf(T.DoubleType())
def outline_apposed(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, reach: pd.Series) -> pd.Series:
    return pd.Series([apposed_wall(v, w, r) if (v := ring(a, b)) is not None and (w := ring(c, d)) is not None else None for a, b, c, d, r in zip(ax, ay, bx, by, reach)], dtype=float)


@F.pandas_udf(T.DoubleType())
def outline_shared(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series([shared_boundary(v, w) if (v := ring(a, b)) is not None and (w := ring(c, d)) is not None else None for a, b, c, d in zip(ax, ay, bx, by)], dtype=float)


@F.pandas_udf(T.BinaryType())
def as_wkb(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([to_wkb(v) if (v := ring(x, y)) is not None else None for x, y in zip(xs, ys)])


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("xs", "ys")]))
def rings_from_wkb(data: pd.Series) -> pd.DataFrame:
    rings = [from_wkb(x) for x in data]
    return pd.DataFrame({"xs": [None if v is None else v[:, 0] for v in rings], "ys": [None if v is None else v[:, 1] for v in rings]})


def repaired(outlines: DataFrame, xs: str, ys: str, precision: float | None = None) -> DataFrame:
    """outlines with simple rings: crossing ones keep their largest loop, vertices snap to the precision grid if the ring stays simple, hopeless ones become null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for x, y in zip(pdf[xs], pdf[ys]):
                v = ring(x, y)
                v = simple_part(v) if v is not None else None
                if v is not None and precision:
                    snapped = ring(*(np.round(v / precision) * precision).T)
                    same = simple_part(snapped) if snapped is not None else None
                    v = snapped if same is not None and len(same) == len(snapped) else v
                got.append(v)
            yield pdf.assign(**{xs: [None if v is None else v[:, 0] for v in got], ys: [None if v is None else v[:, 1] for v in got]})

    return outlines.mapInPandas(run, outlines.schema)


def contact_edges(candidates: DataFrame, outlines: DataFrame, ident: str, xs: str, ys: str, tolerance: float, reach: float, scale: float = 1.0) -> DataFrame:
    """i, j, wall_dist_um, shared_wall_um, apposed_wall_um of candidate pairs whose outlines are at most tolerance apart (inclusive, in µm).

    Pairs whose bounding boxes are farther apart go first, in the engine; then comes the distance, and the dearer measures only for what is left.
    """
    box = {f"{f}{c}": getattr(F, f"array_{f}")(F.filter(n, lambda v: ~F.isnan(v))) for f in ("min", "max") for c, n in (("x", xs), ("y", ys))}
    boxed = outlines.select(F.col(ident).alias("id"), F.col(xs).alias("x"), F.col(ys).alias("y"), *(v.alias(k) for k, v in box.items()))
    side = lambda n: boxed.select(*(F.col(c).alias(n if c == "id" else f"{n}{c}") for c in boxed.columns))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"imin{c}") - F.col(f"jmax{c}"), F.col(f"jmin{c}") - F.col(f"imax{c}"))
    apart = F.hypot(gap("x"), gap("y")) * scale > tolerance * (1 + 1e-9) + 1e-9
    pairs = candidates.select("i", "j").join(side("i"), "i").join(side("j"), "j").filter(~apart).select("i", "j", "ix", "iy", "jx", "jy")
    # As many tasks as the session shuffles into, however few bytes they are: the kernel's time counts, not its input.
    near = pairs.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i", "j").withColumn("wall_dist_um", outline_distance("ix", "iy", "jx", "jy") * scale)
    near = near.filter(F.col("wall_dist_um") <= tolerance)
    return near.select("i", "j", "wall_dist_um", (outline_shared("ix", "iy", "jx", "jy") * scale).alias("shared_wall_um"), (outline_apposed("ix", "iy", "jx", "jy", F.lit(reach / scale)) * scale).alias("apposed_wall_um"))


def add_apposed_wall(edges: DataFrame, outlines: DataFrame, ident: str, xs: str, ys: str, reach: float, scale: float = 1.0) -> DataFrame:
    """edges of any graph with apposed_wall_um of their cells' outlines; null where an outline is missing."""
    side = lambda n: outlines.select(F.col(ident).alias(n), F.col(xs).alias(f"__{n}x"), F.col(ys).alias(f"__{n}y"))
    both = edges.drop("apposed_wall_um").join(side("i"), "i", "left").join(side("j"), "j", "left")
    return both.withColumn("apposed_wall_um", outline_apposed("__ix", "__iy", "__jx", "__jy", F.lit(reach / scale)) * scale).drop("__ix", "__iy", "__jx", "__jy")


def add_outline_gap(edges: DataFrame, outlines: DataFrame, ident: str, xs: str, ys: str, scale: float = 1.0) -> DataFrame:
    """edges with wall_dist_um, the gap between their cells' outlines; null where one is missing."""
    side = lambda n: outlines.select(F.col(ident).alias(n), F.col(xs).alias(f"__{n}x"), F.col(ys).alias(f"__{n}y"))
    both = edges.drop("wall_dist_um").join(side("i"), "i", "left").join(side("j"), "j", "left")
    gap = outline_distance("__ix", "__iy", "__jx", "__jy") * scale
    return both.withColumn("wall_dist_um", F.when(F.isnan(gap), F.lit(None)).otherwise(gap)).drop("__ix", "__iy", "__jx", "__jy")
