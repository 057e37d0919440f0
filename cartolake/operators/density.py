"""Kernel density over the pixels of a canvas."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions.values import byte, color
from cartolake.operators.classify import ramp_blend

#: The default ramp, and radius, intensity and opacity.
RAMP = [(0, 0, 255, 0), (0, 0, 255, 255), (0, 255, 0, 255), (255, 255, 0, 255), (255, 0, 0, 255)]
RADIUS, INTENSITY, OPACITY = 20.0, 1.0, 0.8
#: Pixels of a canvas that a task holds as one array.
DENSE_PIXELS = 1 << 22


def kernel_density(points: DataFrame, box: tuple[float, float, float, float], width: int, height: int, radius: float = RADIUS, intensity: float = INTENSITY, weight: str | None = None) -> DataFrame:
    """(px, py, density): each point adds weight * intensity * exp(-d^2 / 2 s^2), s a third of the radius, to pixels within the radius.

    Each task adds its points up on pixels before the shuffle, so only sums travel: on a canvas of
    up to DENSE_PIXELS once for all its points, on a larger one for each chunk of them. Points off the canvas
    still count at its edges. A missing weight is 1; points without coordinates count nowhere.
    """
    x0, y0, x1, y1 = box
    sx = (F.col("x") - x0) * (width / (x1 - x0) if x1 != x0 else 0.0)
    sy = (F.lit(float(y1)) - F.col("y")) * (height / (y1 - y0) if y1 != y0 else 0.0)
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    rows = points.select(sx.alias("sx"), sy.alias("sy"), w.cast("double").alias("w")).filter("sx IS NOT NULL AND sy IS NOT NULL")
    sigma = radius / 3.0
    steps = np.arange(math.ceil(2 * radius) + 2)
    chunk = max(1, (1 << 20) // len(steps) ** 2)

    def reach(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        pixel = np.floor(at - radius)[:, None] + steps
        d2 = (pixel - at[:, None]) ** 2
        return pixel, np.where((pixel >= 0) & (pixel < n), d2, np.inf)

    def spread(sx: np.ndarray, sy: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        px, dx = reach(sx, width)
        py, dy = reach(sy, height)
        gx, gy = np.exp(-dx / (2.0 * sigma * sigma)), np.exp(-dy / (2.0 * sigma * sigma)) * (w * intensity)[:, None]
        point, row, column = np.nonzero(dy[:, :, None] + dx[:, None, :] <= radius * radius)
        return (py[point, row] * width + px[point, column]).astype(np.int64), gy[point, row] * gx[point, column]

    def onto(total: np.ndarray, met: np.ndarray, sx: np.ndarray, sy: np.ndarray, w: np.ndarray) -> None:
        """Adds each point's square of the canvas in place: rows times columns, inside the disc."""
        px, dx = reach(sx, width)
        py, dy = reach(sy, height)
        gx, gy = np.exp(-dx / (2.0 * sigma * sigma)), np.exp(-dy / (2.0 * sigma * sigma)) * (w * intensity)[:, None]
        x0, x1 = (np.clip(v, 0, width).astype(np.int64) for v in (px[:, 0], px[:, -1] + 1))
        y0, y1 = (np.clip(v, 0, height).astype(np.int64) for v in (py[:, 0], py[:, -1] + 1))
        a, c = (x0 - px[:, 0]).astype(np.int64), (y0 - py[:, 0]).astype(np.int64)
        limit = radius * radius
        for i, (l, r, t, b, u, v) in enumerate(zip(x0.tolist(), x1.tolist(), y0.tolist(), y1.tolist(), a.tolist(), c.tolist(), strict=True)):
            if l < r and t < b:
                columns, rows = slice(u, u + r - l), slice(v, v + b - t)
                inside = dy[i, rows, None] + dx[i, columns] <= limit
                total[t:b, l:r] += (gy[i, rows, None] * gx[i, columns]) * inside
                met[t:b, l:r] |= inside

    def sums(pixel: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((pixel % width).astype(np.int32)), pa.array((pixel // width).astype(np.int32)), pa.array(value)], names=["px", "py", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = width * height <= DENSE_PIXELS
        total = np.zeros((height, width) if dense else (0, 0))
        met = np.zeros(total.shape, dtype=bool)
        for b in batches:
            sx, sy, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("sx", "sy", "w"))
            use = (np.abs(sx) < 1e15) & (np.abs(sy) < 1e15)
            sx, sy, w = sx[use], sy[use], w[use]
            for at in range(0, len(sx), chunk):
                some = sx[at : at + chunk], sy[at : at + chunk], w[at : at + chunk]
                if dense:
                    onto(total, met, *some)
                else:
                    pixel, value = spread(*some)
                    pixel, number = np.unique(pixel, return_inverse=True)
                    yield sums(pixel, np.bincount(number, value, minlength=len(pixel)))
        found = np.flatnonzero(met)
        yield sums(found, total.ravel()[found])

    return rows.mapInArrow(add, "px int, py int, v double").groupBy("px", "py").agg(F.sum("v").alias("density"))


def heatmap(density: DataFrame, ramp: list[tuple[int, ...]] | None = None, opacity: float = OPACITY) -> DataFrame:
    """(px, py, t, rgba): densities over the largest, coloured by the ramp; alpha is t * opacity * 255, cut to a whole number."""
    top = density.agg(F.max("density").alias("_top"))
    rows = density.crossJoin(F.broadcast(top)).filter("_top > 0")
    t = F.col("density") / F.col("_top")
    c = ramp_blend(ramp or RAMP, F.col("t"))
    return rows.withColumn("t", t).select("px", "py", "t", color(c["r"], c["g"], c["b"], byte(F.col("t") * opacity * 255.0)).alias("rgba"))


def kernel_pixels(radius: float) -> int:
    """How many pixels a point is generated onto."""
    r = math.ceil(radius)
    return sum(1 for x in range(-r, r + 1) for y in range(-r, r + 1) if x * x + y * y <= radius * radius)
