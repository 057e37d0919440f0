"""Data classification: class breaks, ramps and sizes.

Breaks are a few numbers from one aggregate; values are then classified by comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.functions.values import COLOR_TYPE, color
from cartolake.operators.ranges import carried, in_ranges
from cartolake.operators.scratch import kept

#: The public ColorBrewer Set1 colours.
CATEGORICAL = ((228, 26, 28), (55, 126, 184), (77, 175, 74), (152, 78, 163), (255, 127, 0), (255, 255, 51), (166, 86, 40), (247, 129, 191), (153, 153, 153))
FLANNERY = 0.5716
#: Values of a segment of natural breaks, which one task solves.
SEGMENT_ROWS = 1 << 16


def equal_interval(df: DataFrame, column: str, k: int) -> list[float]:
    """k - 1 breaks at equal steps between minimum and maximum."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return [] if low is None or k < 2 else [low + (high - low) / k * i for i in range(1, k)]


def quantile(df: DataFrame, column: str, k: int) -> list[float]:
    """Breaks at the sorted values of index min(i * n // k, n - 1), exactly, duplicates kept.

    Values are counted, the counts range-partitioned and summed; only the k - 1 wanted ranks come
    to the driver, so no task sorts all rows.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    placed = carried(in_ranges(values.groupBy("v").count(), "v"), "part", before=F.col("count"))
    n = values.count()
    if not n or k < 2:
        return []
    ranks = [min(i * n // k, n - 1) for i in range(1, k)]
    upto = placed.withColumn("upto", F.col("before") + F.sum("count").over(Window.partitionBy("part").orderBy("v")))
    wanted = upto.withColumn("rank", F.explode(F.array(*[F.lit(r).cast("long") for r in sorted(set(ranks))]))).filter("rank < upto AND rank >= upto - count")
    found = {r["rank"]: r["v"] for r in wanted.select("rank", "v").collect()}
    return [found[r] for r in ranks]


def _spread(s1: np.ndarray, s2: np.ndarray, start: np.ndarray, end: np.ndarray, e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Squared deviations of the values start..end - 1 from their mean, from sums before start and before end."""
    return np.maximum((e2 - s2) - (e1 - s1) ** 2 / (end - start), 0.0)


def _best_starts(starts: DataFrame, wanted: list[tuple[int, int, int, float, float]]) -> DataFrame:
    """(end, cost, start) for ends (end, left, right, s1, s2): the cheapest of the starts left..right below each.

    Every block of starts (block, i, s1, s2, cost) tries the ends that it can serve; the least of
    all blocks comes out, ties to the smallest start.
    """
    asked = np.array(wanted)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, s1, s2, cost = (b.column(c).to_numpy() for c in ("i", "s1", "s2", "cost"))
            order = np.argsort(i)
            i, s1, s2, cost = i[order], s1[order], s2[order], cost[order]
            found = []
            for end, left, right, e1, e2 in asked[(asked[:, 1] <= i[-1]) & (asked[:, 2] >= i[0])] if len(i) else ():
                x, y = np.searchsorted(i, left), np.searchsorted(i, min(right, end - 1), side="right")
                if y > x:
                    total = cost[x:y] + _spread(s1[x:y], s2[x:y], i[x:y], end, e1, e2)
                    at = int(np.argmin(total))
                    found.append((int(end), float(total[at]), int(i[x + at])))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["end", "cost", "start"])

    tried = starts.select("i", "s1", "s2", "cost").mapInArrow(best, "end long, cost double, start long")
    return tried.groupBy("end").agg(F.min(F.struct("cost", "start")).alias("m")).select("end", "m.cost", "m.start")


def _segment_costs(key: tuple, ends: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """The cheapest start of each end of a segment, among the starts that its bounds leave; halves within the bounds of their middle."""
    ends, starts = ends.sort_values("i"), starts.sort_values("i")
    e, e1, e2 = (ends[c].to_numpy() for c in ("i", "s1", "s2"))
    i, s1, s2, before = (starts[c].to_numpy() for c in ("i", "s1", "s2", "cost"))
    cost, first = np.full(len(e), np.inf), np.zeros(len(e), dtype=np.int64)
    low, high, left, right = (np.array([v]) for v in (0, len(e) - 1, 0, len(i) - 1))
    while len(low):
        # all middles of a depth at once: their stretches of starts lie end to end
        mid = (low + high) // 2
        n = np.minimum(right, np.searchsorted(i, e[mid]) - 1) - left + 1
        begin, own = np.cumsum(n) - n, np.repeat(np.arange(len(mid)), n)
        x, end = left[own] + np.arange(len(own)) - begin[own], mid[own]
        total = before[x] + _spread(s1[x], s2[x], i[x], e[end], e1[end], e2[end])
        best = np.minimum.reduceat(total, begin)
        hits = np.flatnonzero((total == best[own]) | np.isnan(total))
        at = x[hits[np.diff(own[hits], prepend=-1) > 0]]
        cost[mid], first[mid] = best, i[at]
        low, high, left, right = (np.concatenate(v) for v in ((low, mid + 1), (mid - 1, high), (left, at), (at, right)))
        some = low <= high
        low, high, left, right = low[some], high[some], left[some], right[some]
    return pd.DataFrame({"i": e, "s1": e1, "s2": e2, "cost": cost, "start": first})


def _next_layer(sums: DataFrame, layer: DataFrame, n: int, c: int, rows: int) -> DataFrame:
    """(i, s1, s2, cost, start): costs of c + 1 classes for the first i values, from the layer of c classes.

    The best start never falls as the end grows. So ends at every `rows`-th place are solved first,
    by rounds that leave sixteenths of the bounds, and bound the starts of all ends between them:
    each segment of ends then meets a stretch of starts, and all stretches together are the layer
    once. A segment that still has too many starts is cut into smaller ones.
    """
    spark = sums.sparkSession
    solved: dict[int, int] = {}

    def ends_at(wanted: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float, float]]:
        keys = spark.createDataFrame(wanted, "i long, left long, right long")
        return [tuple(r) for r in sums.join(F.broadcast(keys), "i").select("i", "left", "right", "s1", "s2").collect()]

    segments: list[tuple[int, int, int, int]] = []
    alone: list[tuple[int, int, int]] = []
    open_ = [(c + 1, n, c, n - 1)]
    while open_:
        wanted: dict[int, tuple[int, int]] = {}
        cuts = []
        for low, high, left, right in open_:
            if right - left < 4 * rows and high - low < rows:
                segments.append((low, high, left, right))
                continue
            if high - low < 2:  # still too many starts: each end on its own, over blocks of starts
                alone += [(end, left, right) for end in range(low, high + 1)]
                continue
            step = max(1, (high - low + 1) // 16)
            points = list(range(low + step - 1, high, step))
            wanted |= dict.fromkeys(points, (left, right))
            cuts.append((low, high, left, right, points))
        open_ = []
        if not wanted:
            break
        solved |= {r["end"]: r["start"] for r in _best_starts(layer, ends_at([(k, *v) for k, v in wanted.items()])).collect()}
        for low, high, left, right, points in cuts:
            for point in points:
                open_.append((low, point, left, solved[point]))
                low, left = point + 1, solved[point]
            open_.append((low, high, left, right))
    spans = [(k, *s) for k, s in enumerate(segments)]
    # few segments for many values; a range join would be a loop, so numbers of blocks are joined
    block = lambda c: (F.col(c) / F.lit(rows)).cast("long")
    of = lambda a, b: spark.createDataFrame(spans, "segment long, low long, high long, left long, right long").select("segment", F.col(a).alias("from"), F.col(b).alias("to"), F.explode(F.sequence(block(a), block(b))).alias("block"))
    within = lambda df, a, b: df.withColumn("block", block("i")).join(F.broadcast(of(a, b)), "block").filter(F.col("i").between(F.col("from"), F.col("to")))
    ends = within(sums, "low", "high").select("segment", "i", "s1", "s2")
    starts = within(layer, "left", "right").select("segment", "i", "s1", "s2", "cost")
    solved_segments = ends.groupBy("segment").cogroup(starts.groupBy("segment")).applyInPandas(_segment_costs, "i long, s1 double, s2 double, cost double, start long")
    if alone:
        found = _best_starts(layer, ends_at(alone)).join(sums, F.col("end") == F.col("i"))
        solved_segments = solved_segments.unionByName(found.select("i", "s1", "s2", "cost", "start"))
    return kept(solved_segments)


def natural_breaks(df: DataFrame, column: str, k: int, rows: int = SEGMENT_ROWS) -> list[float]:
    """Fisher-Jenks breaks over the sorted distinct values; with k of them or fewer, all but the first.

    The dynamic programme runs layer by layer, a layer a class: values lie in ranges with sums
    carried over them, and each layer is a few jobs over tables, tasks of `rows` ends. Only places
    and bounds of segments come to the driver, one for `rows` values.
    """
    # written, as four jobs read them
    values = kept(df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").distinct())
    middle = values.agg(F.avg("v").alias("m"), F.count("*").alias("n")).first()
    n = middle["n"]
    if n <= k or k < 2:
        return [r["v"] for r in values.orderBy("v").collect()[1:]] if n <= k else []
    x = F.col("v") - F.lit(middle["m"])
    placed = carried(in_ranges(values, "v"), "part", before=F.lit(1), b1=x, b2=x * x)
    upto = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    inside = Window.partitionBy("part").orderBy("v")
    place = (F.col("before") + F.row_number().over(inside) - 1).cast("long")
    starts = placed.select("v", place.alias("i"), (F.col("b1") + zero(F.sum(x).over(upto))).alias("s1"), (F.col("b2") + zero(F.sum(x * x).over(upto))).alias("s2"))
    starts = kept(starts)
    total = values.agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2")).first()
    end = values.sparkSession.createDataFrame([(n, total["s1"], total["s2"])], "i long, s1 double, s2 double")
    sums = kept(starts.select("i", "s1", "s2").unionByName(end))  # sums of the i values before a place
    one = F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("i"))
    layers = [kept(sums.filter("i > 0").select("i", "s1", "s2", one.alias("cost"), F.lit(0).cast("long").alias("start")))]
    for c in range(1, k - 1):
        layers.append(_next_layer(sums, layers[-1], n, c, rows))
    last = _best_starts(layers[-1], [(n, k - 1, n - 1, total["s1"], total["s2"])]).first()
    places = [last["start"]]
    for layer in layers[:0:-1]:
        places.append(layer.filter(F.col("i") == places[-1]).first()["start"])
    found = {r["i"]: r["v"] for r in starts.join(F.broadcast(values.sparkSession.createDataFrame([(p,) for p in places], "i long")), "i").select("i", "v").collect()}
    return [found[p] for p in reversed(places)]


def standard_deviation(df: DataFrame, column: str, spread: float = 2.0) -> list[float]:
    """Steps of one population deviation from mean - spread deviations up to beyond mean + spread deviations."""
    mean, sigma = df.agg(F.avg(column), F.stddev_pop(column)).first()
    out: list[float] = []
    if not sigma:
        return out
    at, end = mean - spread * sigma, mean + spread * sigma + sigma / 2
    while at < end:
        out.append(at)
        at += sigma
    return out


def manual(breaks: list[float]) -> list[float]:
    return sorted(breaks)


def classify(value: Column, breaks: list[float]) -> Column:
    """The number of breaks not above the value; a value on a break is in the next class."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in breaks]), lambda b: b <= value)) if breaks else F.when(value.isNotNull(), 0)


def ramp_column(ramp: list[tuple[int, ...]]) -> Column:
    return F.array(*[color(*c) for c in ramp]) if ramp else F.array().cast(f"array<{COLOR_TYPE}>")


def ramp_color(ramp: list[tuple[int, ...]], index: Column) -> Column:
    """A class's colour, the last one beyond; grey for an empty ramp."""
    if not ramp:
        return color(128, 128, 128)
    return F.get(ramp_column(ramp), F.least(index, F.lit(len(ramp) - 1)))


def ramp_blend(ramp: list[tuple[int, ...]], t: Column) -> Column:
    """A colour between those of the ramp, each channel rounded."""
    if not ramp:
        return color(128, 128, 128)
    if len(ramp) == 1:
        return color(*ramp[0])
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (len(ramp) - 1)
    low = F.least(F.floor(at).cast("int"), F.lit(len(ramp) - 2))
    a, b, part = F.get(ramp_column(ramp), low), F.get(ramp_column(ramp), low + 1), at - low
    return color(*[F.round(a[p] + (b[p] - a[p]) * part) for p in "rgba"])


def blue_to_red(n: int) -> list[tuple[int, int, int]]:
    return [(int(255 * t), 0, int(255 * (1 - t))) for t in (i / max(n - 1, 1) for i in range(n))]


def diverging(n: int) -> list[tuple[int, int, int]]:
    """Blue over white to red."""
    out = []
    for t in (i / max(n - 1, 1) for i in range(n)):
        s = t * 2 if t < 0.5 else (t - 0.5) * 2
        out.append((int(255 * s), int(255 * s), 255) if t < 0.5 else (255, int(255 * (1 - s)), int(255 * (1 - s))))
    return out


def proportional_radius(value: Column, low: float, high: float, min_radius: float, max_radius: float, flannery: bool = False) -> Column:
    """A symbol's radius for a value, linear or by Flannery's exponent; the least for a range without extent."""
    if high <= low:
        return F.lit(float(min_radius))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))
    return F.lit(float(min_radius)) + (F.pow(t, FLANNERY) if flannery else t) * (max_radius - min_radius)
