"""Easing curves over 0..1, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(t: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def ease(t: Column, kind: str = "linear") -> Column:
    """linear, in, out or in-out; the curves are quadratic, t is held to 0..1."""
    t = clamp01(t)
    if kind == "linear":
        return t
    if kind == "in":
        return t * t
    if kind == "out":
        return t * (F.lit(2.0) - t)
    if kind == "in-out":
        return F.when(t < 0.5, t * t * 2.0).otherwise(F.lit(1.0) - F.pow(t * -2.0 + 2.0, 2) / 2.0)
    raise ValueError(f"unknown easing {kind}")


def exponential(t: Column, base: float) -> Column:
    """(base^t - 1) / (base - 1), which is t for a base of 1."""
    return t if abs(base - 1) < 1e-6 else (F.pow(F.lit(float(base)), t) - 1.0) / (base - 1)


def cubic_bezier(x: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """The curve's y at x: eight Newton steps for the parameter, as a fold so that the plan stays small."""
    at = lambda t, a, b: 3.0 * a * t * (1.0 - t) * (1.0 - t) + 3.0 * b * t * t * (1.0 - t) + t * t * t
    slope = lambda t: 3.0 * x1 * (1.0 - t) * (1.0 - t) + 6.0 * (x2 - x1) * t * (1.0 - t) + 3.0 * (1.0 - x2) * t * t

    def step(t: Column, _: Column) -> Column:
        d = slope(t)
        return F.when(F.abs(d) < 1e-12, t).otherwise(clamp01(t - (at(t, x1, x2) - x) / d))

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), x, step, lambda t: at(t, y1, y2))
