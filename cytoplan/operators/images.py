"""Image windows over a table of tiles: membership, levels, crops and masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import disk_mask, polygon_mask, ring

#: Half side of a crop in µm, side of a decoded block in pixels, output side.
HALF_UM, BLOCK_PX, OUT_PX = 10.0, 4096, 256


def in_window(x: str | Column, y: str | Column, x0, y0, x1, y1) -> Column:
    """Inside a crop window: from the left and upper side on, up to but not on the others."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def finest_level(levels: DataFrame, want_px: int, most_px: int) -> DataFrame:
    """The level (factor: downsampling) with the least factor for which want_px / factor fits most_px, else the coarsest."""
    fits = F.lit(want_px) / F.col("factor") <= most_px
    return levels.orderBy(F.when(fits, 0).otherwise(1), F.when(fits, F.col("factor")).otherwise(-F.col("factor"))).limit(1)


def read_window(tiles: DataFrame, level: int, x0: int, y0: int, x1: int, y1: int, side: int, channels: list[int] | None = None) -> np.ndarray:
    """Pixels (height, width, channels) of a window from tiles (level, channel, ty, tx, pixels: array of side * side, row by row); what no tile covers is zero. A display read: only the window's tiles reach the driver."""
    part = tiles.filter((F.col("level") == level) & F.col("tx").between(x0 // side, (x1 - 1) // side) & F.col("ty").between(y0 // side, (y1 - 1) // side))
    part = part.filter(F.col("channel").isin(channels)) if channels else part
    rows = part.select("channel", "ty", "tx", "pixels").collect()
    names = channels or sorted({r["channel"] for r in rows})
    out = np.zeros((y1 - y0, x1 - x0, len(names)))
    for r in rows:
        px = np.asarray(r["pixels"], float).reshape(side, side)
        oy, ox = r["ty"] * side, r["tx"] * side
        a, b, c, d = max(y0, oy), min(y1, oy + side), max(x0, ox), min(x1, ox + side)
        out[a - y0 : b - y0, c - x0 : d - x0, names.index(r["channel"])] = px[a - oy : b - oy, c - ox : d - ox]
    return out


def resample(window: np.ndarray, out: int) -> np.ndarray:
    """Bilinear resampling of (height, width) to out x out."""
    h, w = window.shape
    y, x = (np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1) for n in (h, w))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (window[y0][:, x0] * (1 - fx) + window[y0][:, x1] * fx) * (1 - fy) + (window[y1][:, x0] * (1 - fx) + window[y1][:, x1] * fx) * fy


def crop_cells(
    tiles: DataFrame, cells: DataFrame, side: int, scale: float, half_um: float = HALF_UM, out: int = OUT_PX, mask: str = "none", radius_um: float = 25.0, block: int = BLOCK_PX, outside: str = "error"
) -> DataFrame:
    """cell_id, channel, pixels: a square window of 2 * half_um about each cell (cell_id, x, y in pixels; xs, ys: its outline for mask polygon), resampled to out x out.

    Cells are grouped by blocks of the image; a tile goes once to each block whose windows it may touch and is put into the block's region once for all its cells, so no
    pixels are sent per cell. Zeros pad what lies outside the image. mask: none, disk (zero within radius_um of the middle) or polygon (zero outside the outline). A cell
    whose window no tile touches is an error, or has no row if outside is drop; cells without id or position have none.
    """
    size = max(1, round(2 * half_um / scale))
    at = cells.dropna(subset=["cell_id", "x", "y"])
    keep = ["cell_id", "x", "y", *(["xs", "ys"] if mask == "polygon" else [])]
    want = at.select(*keep, F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by"))
    reach = lambda t: F.explode(F.sequence(F.floor((F.col(t) * side - size) / block), F.floor((F.col(t) * side + side + size) / block)))
    parts = tiles.filter("level = 0").select("channel", "ty", "tx", "pixels").withColumn("bx", reach("tx")).withColumn("by", reach("ty"))
    parts = parts.join(want.select("bx", "by").distinct(), ["bx", "by"], "left_semi")
    kinds = dict(cells.dtypes) | dict(tiles.dtypes)

    def build(c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not len(c):
            return pd.DataFrame(rows, columns=["cell_id", "channel", "pixels"])
        x0, y0 = (np.round(c[k].to_numpy(float) - size / 2).astype(int) for k in ("x", "y"))
        left, top, right, bottom = int(x0.min()), int(y0.min()), int(x0.max()) + size, int(y0.max()) + size
        touched = np.zeros(len(c), bool)
        for channel, own in t.groupby("channel", sort=True):
            region = np.zeros((bottom - top, right - left), np.float32)
            for r in own.itertuples():
                oy, ox = r.ty * side, r.tx * side
                y1, y2, x1, x2 = max(top, oy), min(bottom, oy + side), max(left, ox), min(right, ox + side)
                if y1 < y2 and x1 < x2:
                    region[y1 - top : y2 - top, x1 - left : x2 - left] = np.asarray(r.pixels, np.float32).reshape(side, side)[y1 - oy : y2 - oy, x1 - ox : x2 - ox]
                    touched |= (x0 < ox + side) & (x0 + size > ox) & (y0 < oy + side) & (y0 + size > oy)
            for k in np.flatnonzero(touched):
                window = region[y0[k] - top : y0[k] - top + size, x0[k] - left : x0[k] - left + size].astype(float)
                if mask == "polygon" and (v := ring(c["xs"].iloc[k], c["ys"].iloc[k])) is not None:
                    window = np.where(polygon_mask(v - [x0[k], y0[k]], size, size), window, 0)
                image = resample(window, out)
                if mask == "disk":
                    image = np.where(disk_mask(out, radius_um, size * scale), image, 0)
                rows.append((c["cell_id"].iloc[k], channel, image.ravel()))
        if outside == "error" and not touched.all():
            raise ValueError(f"cell {c['cell_id'].iloc[int(np.argmin(touched))]} lies outside the image")
        return pd.DataFrame(rows, columns=["cell_id", "channel", "pixels"])

    return want.groupBy("bx", "by").cogroup(parts.groupBy("bx", "by")).applyInPandas(build, f"cell_id {kinds['cell_id']}, channel {kinds['channel']}, pixels array<double>")


def display_stretch(window: np.ndarray, low: float = 1.0, high: float = 99.5) -> np.ndarray:
    """A channel's pixels from 0 to 1 between two percentiles; where they are equal, one unit apart."""
    a, b = np.percentile(window, [low, high])
    b = a + 1 if b <= a else b
    return np.clip((window - a) / (b - a), 0, 1)


def display_rgb(planes: np.ndarray) -> np.ndarray:
    """(height, width, 3) from (height, width, channels) of stretched planes: one is grey, the first three are colours, a fourth adds 0.4 of its brightness to all."""
    n = planes.shape[2]
    out = np.zeros((*planes.shape[:2], 3)) if n > 1 else np.repeat(planes, 3, axis=2)
    if n > 1:
        out[..., : min(n, 3)] = planes[..., :3]
    return np.clip(out + 0.4 * planes[..., 3:4], 0, 1) if n > 3 else out


def unknown_channels(have: DataFrame, asked: list[str]) -> list[str]:
    """Asked channels that have (a frame with the column channel) lacks; a caller stops on any."""
    known = {r[0] for r in have.select("channel").distinct().collect()}  # channels are few
    return [c for c in asked if c not in known]


def channel_statistics(crops: DataFrame) -> DataFrame:
    """channel, mean, std: over all pixels of the crops; a standard deviation of zero becomes one."""
    px = F.explode("pixels")
    out = crops.select("channel", px.alias("p")).groupBy("channel").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))
    return out.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def embed_crops(crops: DataFrame, forward) -> DataFrame:
    """cell_id, channel, embedding: forward takes an array (n, pixels) and returns one vector a row; batches stream through each task."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                got = forward(np.stack(pdf["pixels"].to_numpy()))
                yield pd.DataFrame({"cell_id": pdf["cell_id"], "channel": pdf["channel"], "embedding": list(np.asarray(got, np.float32))})

    kinds = dict(crops.dtypes)
    return crops.mapInPandas(run, f"cell_id {kinds['cell_id']}, channel {kinds['channel']}, embedding array<float>")
