"""Pixels as rows: shapes become covered pixels, and pixels are blended in paint order.

A drawing is a table (canvas, layer_ord, fid, px, py, rgba). Shapes are generated onto their
pixels by expressions; what lies on a pixel is sorted and folded in streams. So neither a canvas
nor a pixel is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.functions.values import byte, color
from cartolake.operators.scratch import kept, spread
from cartolake.operators.stacks import folded, uppermost

KEYS = ["canvas", "layer_ord", "fid"]
#: Polygons that a task scans together.
POLYGONS = 2048
#: Pixels that a task has at hand at a time.
PIXELS = 1 << 18
#: Pixel rows of a line that a task holds together.
BAND = 256


def _range(low: Column, high: Column, n: int) -> Column:
    a, b = F.greatest(F.lit(0), low.cast("int")), F.least(F.lit(n - 1), high.cast("int"))
    return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))


def _onto(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> DataFrame:
    rows = df.withColumn("py", F.explode(_range(y0, y1, height)))
    return rows.withColumn("px", F.explode(_range(x0, x1, width)))


def faded(rgba: Column, coverage: Column) -> Column:
    return color(rgba["r"], rgba["g"], rgba["b"], byte(rgba["a"] * coverage))


def discs(points: DataFrame, width: int, height: int, smooth: bool = False) -> DataFrame:
    """Points (keys, x, y on screen, radius, rgba) as discs. Plain discs have whole radii and centres; smooth ones a covered edge."""
    if smooth:
        rows = _onto(points, F.floor(F.col("x") - F.col("radius") - 1), F.floor(F.col("y") - F.col("radius") - 1), F.ceil(F.col("x") + F.col("radius") + 1), F.ceil(F.col("y") + F.col("radius") + 1), width, height)
        d = F.sqrt(F.pow(F.col("px") + 0.5 - F.col("x"), 2) + F.pow(F.col("py") + 0.5 - F.col("y"), 2))
        cover = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("radius") + 0.5 - d))
        return rows.withColumn("_c", cover).filter("_c > 0").select(*KEYS, "px", "py", faded(F.col("rgba"), F.col("_c")).alias("rgba"))
    p = points.withColumns({"_x": F.col("x").cast("int"), "_y": F.col("y").cast("int"), "_r": F.col("radius").cast("int")})
    rows = _onto(p, F.col("_x") - F.col("_r"), F.col("_y") - F.col("_r"), F.col("_x") + F.col("_r"), F.col("_y") + F.col("_r"), width, height)
    near = F.pow(F.col("px") - F.col("_x"), 2) + F.pow(F.col("py") - F.col("_y"), 2) <= F.col("_r") * F.col("_r")
    return rows.filter(near).select(*KEYS, "px", "py", "rgba")


def segments(lines: DataFrame, dashes: list[float] | None = None) -> DataFrame:
    """Lines (keys, pts, ...) as segments x0, y0, x1, y1, at (length before it) and the other columns.

    With dashes, only the drawn pieces of each segment; the pattern goes on over vertices. A
    pattern without length is refused.
    """
    if dashes is not None and sum(dashes) <= 0:
        raise ValueError("a dash pattern needs a length")
    zero = F.struct(F.lit(0.0).alias("upto"), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,at:double,len:double>>").alias("segs"), F.get("pts", F.lit(0)).alias("p"))

    def grow(s: Column, q: Column) -> Column:
        size = F.sqrt(F.pow(q["x"] - s["p"]["x"], 2) + F.pow(q["y"] - s["p"]["y"], 2))
        seg = F.struct(s["p"]["x"].alias("x0"), s["p"]["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"), s["upto"].alias("at"), size.alias("len"))
        return F.struct((s["upto"] + size).alias("upto"), F.concat(s["segs"], F.array(seg)).alias("segs"), q.alias("p"))

    # lengths first, in one pass, so that a segment's row doesn't carry its line
    cut = F.aggregate(F.slice("pts", 2, F.size("pts") - 1), zero, grow, lambda s: s["segs"])
    rows = spread(lines.filter(F.size("pts") >= 2), *KEYS).withColumn("_s", cut).drop("pts")
    rows = rows.select(*[c for c in rows.columns if c != "_s"], F.posexplode("_s").alias("_i", "_seg"))
    rows = rows.select("*", *[F.col(f"_seg.{c}").alias("_len" if c == "len" else c) for c in ("x0", "y0", "x1", "y1", "at", "len")])
    if dashes is not None:
        pattern = dashes if len(dashes) % 2 == 0 else dashes * 2
        total, starts = float(sum(pattern)), [float(sum(pattern[:i])) for i in range(len(pattern))]
        on = F.array(*[F.struct(F.lit(starts[i]).alias("s"), F.lit(starts[i] + pattern[i]).alias("e")) for i in range(0, len(pattern), 2)])
        first, last = F.floor(F.col("at") / total), F.floor((F.col("at") + F.col("_len")) / total)
        rows = rows.withColumn("_k", F.explode(F.sequence(first, last))).withColumn("_on", F.explode(on))
        a = F.greatest(F.col("at"), F.col("_k") * total + F.col("_on.s")) - F.col("at")
        b = F.least(F.col("at") + F.col("_len"), F.col("_k") * total + F.col("_on.e")) - F.col("at")
        rows = rows.withColumns({"_a": a, "_b": b}).filter("_a < _b AND _len > 0")
        mid = lambda p, q, t: F.col(p) + (F.col(q) - F.col(p)) * F.col(t) / F.col("_len")
        rows = rows.select("*", mid("x0", "x1", "_a").alias("_x0"), mid("y0", "y1", "_a").alias("_y0"), mid("x0", "x1", "_b").alias("_x1"), mid("y0", "y1", "_b").alias("_y1")).drop("x0", "y0", "x1", "y1")
        rows = rows.withColumnsRenamed({"_x0": "x0", "_y0": "y0", "_x1": "x1", "_y1": "y1"}).drop("_k", "_on", "_a", "_b")
    return rows.drop("_seg", "_len").withColumnRenamed("_i", "seg")


def strokes(segs: DataFrame, width: int, height: int, cap: str = "butt", smooth: bool = False) -> DataFrame:
    """Segments (keys, x0, y0, x1, y1, line_width, rgba) as pixels, each pixel of a line once.

    A pixel is covered if its centre is within half the width of the segment; each row of pixels
    gives the span that the band of the segment has there. Round caps (and
    joins) come from the distance to the end points, square caps from segments that are longer by
    half the width; smooth covers edges by distance. A column `cap` tells the caps of single
    segments. Segments are dealt by line and band of BAND pixel rows, sorted and streamed: a task
    holds the pixels of one line in one band. Segments without a finite place draw nothing.
    """
    segs = segs if "cap" in segs.columns else segs.withColumn("cap", F.lit(cap))
    reach = F.col("line_width") + 1.5
    first, last = (F.floor(f("y0", "y1") / BAND + d * reach / BAND) for f, d in ((F.least, -1), (F.greatest, 1)))
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit((height - 1) // BAND))
    bands = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    numbers = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "line_width")]
    own = segs.select(*KEYS, "rgba", *numbers, F.col("cap").isin("round").alias("_round"), F.col("cap").isin("square").alias("_square"), F.explode(bands).alias("_band"))
    own = spread(own, *KEYS, "_band").sortWithinPartitions(*KEYS, "_band")
    schema = T.StructType([*[own.schema[k] for k in (*KEYS, "rgba")], T.StructField("px", T.IntegerType()), T.StructField("py", T.IntegerType()), T.StructField("_c", T.DoubleType())])
    hit = own.mapInArrow(lambda batches: _stroked(batches, width, height, 0.5 if smooth else 0.0), schema)
    return hit.select(*KEYS, "px", "py", faded(F.col("rgba"), F.col("_c")).alias("rgba") if smooth else "rgba")


def _stroked(batches: Iterator[pa.RecordBatch], width: int, height: int, edge: float) -> Iterator[pa.RecordBatch]:
    """Pixels of sorted segments, each pixel of a line and band once with its most cover; edge 0 covers whole pixels."""
    names = [*KEYS, "rgba", "_band"]
    before: pa.RecordBatch | None = None  # a row of the line and band that is still coming
    codes, covers = np.zeros(0, np.int64), np.zeros(0)

    def once(code: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not edge:
            code = np.unique(code)
            return code, np.ones(len(code))
        by = np.lexsort((cover, code))
        code, cover = code[by], cover[by]
        top = np.append(code[1:] != code[:-1], True) if len(code) else np.zeros(0, bool)
        return code[top], cover[top]

    def rows(source: pa.RecordBatch, first: np.ndarray, code: np.ndarray, cover: np.ndarray) -> pa.RecordBatch:
        own, inside = pa.array(first[code // (BAND * width)]), code % (BAND * width)
        band = source.column("_band").take(own).to_numpy(zero_copy_only=False)
        cells = [pa.array((inside % width).astype(np.int32)), pa.array((band * BAND + inside // width).astype(np.int32)), pa.array(cover)]
        return pa.RecordBatch.from_arrays([*[source.column(k).take(own) for k in (*KEYS, "rgba")], *cells], names=[*KEYS, "rgba", "px", "py", "_c"])

    for b in batches:
        if not b.num_rows:
            continue
        source = pa.Table.from_batches(([b.slice(0, 1).select(names)] if before is None else [before]) + [b.select(names)]).combine_chunks().to_batches()[0]
        other = np.zeros(b.num_rows, bool)
        for k in (*KEYS, "_band"):
            code = source.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            other |= code[1:] != code[:-1]
        group = np.cumsum(other)
        first = np.append(0, np.flatnonzero(other) + 1)
        x0, y0, x1, y1, half = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1", "line_width"))
        half = half / 2.0
        band = b.column("_band").to_numpy(zero_copy_only=False)
        rounded, squared = (b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_round", "_square"))
        dx, dy = x1 - x0, y1 - y0
        size2 = dx * dx + dy * dy
        sound = np.isfinite(size2 + x0 + y0 + half)
        reach = half * np.where(squared, 2.0, 1.0) + 1
        clip = lambda v, n, ok: np.clip(np.where(ok, v, -1), -1, n).astype(np.int64)
        low = np.maximum(clip(np.floor(np.minimum(y0, y1) - reach), height, sound), band * BAND)
        high = np.minimum(np.minimum(clip(np.ceil(np.maximum(y0, y1) + reach), height, sound), height - 1), band * BAND + BAND - 1)
        i, py = _ranges(low, np.where(sound, np.maximum(high - low + 1, 0), 0))
        # the band of the segment's line meets a row of pixels in one span; only that is tried, not the segment's box
        level = dy[i] == 0
        slope = dx[i] / np.where(level, 1.0, dy[i])
        middle, wide = x0[i] + (py + 0.5 - y0[i]) * slope, (half[i] + edge) * np.sqrt(slope * slope + 1.0) + 1.0
        left, right = np.floor(np.minimum(x0, x1) - reach)[i], np.ceil(np.maximum(x0, x1) + reach)[i]
        left = np.maximum(clip(np.where(level, left, np.maximum(left, np.floor(middle - wide))), width, True), 0)
        right = np.minimum(clip(np.where(level, right, np.minimum(right, np.ceil(middle + wide))), width, True), width - 1)
        across = np.maximum(right - left + 1, 0)
        for at in _slices(across, PIXELS):
            k, px = _ranges(left[at], across[at])
            line, k = py[at][k], i[at][k]
            ux, uy, some = px + 0.5 - x0[k], line + 0.5 - y0[k], size2[k] > 0
            size = np.where(some, size2[k], 1.0)
            along = (ux * dx[k] + uy * dy[k]) / size
            t = np.minimum(1.0, np.maximum(0.0, along))
            ex, ey = ux - dx[k] * t, uy - dy[k] * t
            away = np.where(rounded[k], np.sqrt(ex * ex + ey * ey), np.abs(ux * dy[k] - uy * dx[k]) / np.sqrt(size))
            cover = np.minimum(1.0, half[k] + edge - away) if edge else (away <= half[k]).astype(np.float64)
            longer = np.where(some & squared[k], half[k] / np.sqrt(size), 0.0)
            on = (cover > 0) & (rounded[k] | some & (along >= -longer) & (along <= longer + 1.0))
            k, px, line = k[on], px[on], line[on]
            codes, covers = once(np.append(codes, group[k] * (BAND * width) + (line - band[k] * BAND) * width + px), np.append(covers, cover[on]))
            done = int(np.searchsorted(codes, group[i[at][-1]] * (BAND * width)))
            if done:
                yield rows(source, first, codes[:done], covers[:done])
                codes, covers = codes[done:], covers[done:]
        done = int(np.searchsorted(codes, group[-1] * (BAND * width)))
        if done:
            yield rows(source, first, codes[:done], covers[:done])
        codes, covers = codes[done:] - group[-1] * (BAND * width), covers[done:]
        before = source.slice(source.num_rows - 1, 1)
    if len(codes):
        yield rows(before, np.zeros(1, np.int64), codes, covers)


def _spans(rings: pa.Array, width: int, height: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Polygon, scan line, first pixel and number of pixels of each span of the polygons, even-odd, by polygon and line."""
    owner = pc.list_parent_indices(rings).to_numpy()
    paths = rings.flatten()
    sizes = pc.fill_null(pc.list_value_length(paths), 0).to_numpy()
    x, y = (v.to_numpy(zero_copy_only=False).astype(np.float64) for v in paths.flatten().flatten()[:2])
    begins = np.cumsum(sizes) - sizes
    after = np.arange(len(x)) + 1
    full = sizes > 0
    after[begins[full] + sizes[full] - 1] = begins[full]
    polygon = np.repeat(owner, sizes)
    ax, ay, bx, by = x, y, x[after], y[after]
    use = (np.repeat(sizes, sizes) >= 3) & (ay != by) & np.isfinite(ax + ay + bx + by)
    ax, ay, bx, by, polygon = ax[use], ay[use], bx[use], by[use], polygon[use]
    first = np.maximum(np.ceil(np.minimum(ay, by) * samples - 0.5), 0).astype(np.int64)
    last = np.minimum(np.ceil(np.maximum(ay, by) * samples - 0.5) - 1, height * samples - 1).astype(np.int64)
    edge, line = _ranges(first, np.maximum(last - first + 1, 0))
    at = (line + 0.5) / samples
    cross = ax[edge] + (at - ay[edge]) * (bx[edge] - ax[edge]) / (by[edge] - ay[edge])
    polygon = polygon[edge]
    order = np.lexsort((cross, line, polygon))
    polygon, line, cross = polygon[order], line[order], cross[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (polygon[1:] != polygon[:-1]) | (line[1:] != line[:-1])
    starts = np.flatnonzero(new)
    place = np.arange(len(line)) - starts[np.cumsum(new) - 1] if len(line) else line
    left = np.flatnonzero((place % 2 == 0) & np.append(~new[1:], False)) if len(line) else line
    low = np.maximum(np.ceil(cross[left] - 0.5), 0).astype(np.int64)
    high = np.minimum(np.ceil(cross[left + 1] - 0.5) - 1, width - 1).astype(np.int64)
    return polygon[left], line[left], low, np.maximum(high - low + 1, 0)


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1 and so on, n of each, and whose they are."""
    whose = np.repeat(np.arange(len(n)), n)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n) + first[whose]


def fills(polygons: DataFrame, width: int, height: int, samples: int = 1) -> DataFrame:
    """Polygons (keys, rings array of point arrays on screen, rgba) as pixels, even-odd with holes.

    A polygon's edges meet the scan lines where the polygon lies; the sorted crossings of a line
    give its spans, in Arrow batches without a shuffle. samples > 1 takes that many lines a pixel
    row and covers by their share.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, POLYGONS):
                b = whole.slice(at, POLYGONS)
                polygon, line, low, n = _spans(b.column("rings"), width, height, samples)
                whose = pa.array(polygon)
                cells = [pa.array(v.astype(np.int32)) for v in (line // samples, low, low + n - 1)]
                rows = pa.RecordBatch.from_arrays([*[b.column(k).take(whose) for k in KEYS], b.column("rgba").take(whose), *cells], names=[*KEYS, "rgba", "py", "_a", "_b"])
                yield rows.filter(pa.array(n > 0))

    own = polygons.select(*KEYS, "rgba", "rings")
    schema = T.StructType([*[f for f in own.schema.fields if f.name != "rings"], *[T.StructField(k, T.IntegerType()) for k in ("py", "_a", "_b")]])
    spans = own.filter("rings IS NOT NULL").mapInArrow(scan, schema)
    pixels = spans.select(*KEYS, F.explode(F.sequence("_a", "_b")).alias("px"), "py", "rgba")
    if samples == 1:
        return pixels
    share = F.count("*") / F.lit(float(samples))
    hit = pixels.groupBy(*KEYS, "px", "py").agg(share.alias("_c"), F.first("rgba").alias("rgba"))
    return hit.select(*KEYS, "px", "py", faded(F.col("rgba"), F.col("_c")).alias("rgba"))


def blend(pixels: DataFrame) -> DataFrame:
    """(canvas, px, py, rgba): what lies on each pixel, folded in paint order. Rows with a true column `solid`, if there is one, take the pixel as they are.

    Sorted ranges are streamed, so a pixel's layers may be any number and lie in many tasks.
    """
    solid = F.coalesce(F.col("solid"), F.lit(False)) if "solid" in pixels.columns else F.lit(False)
    return folded(pixels.withColumn("solid", solid))


def blended_strokes(lines: DataFrame, width: int, height: int, cap: str = "butt", smooth: bool = False, dashes: list[float] | None = None) -> DataFrame:
    """blend(strokes(segments(lines))): of lines (keys, pts, line_width, rgba) equal in all but their order, only the last ones are drawn.

    All are drawn only where those leave a pixel open. A line of which more lie below tells their
    alpha to its pixels by a clear layer at the bottom.
    """
    drawn = lambda rows: strokes(segments(rows, dashes), width, height, cap, smooth).withColumn("solid", F.lit(False))
    last, more = uppermost(lines)
    # lines of one alpha are one layer here, whose order carries the alpha
    below = more.filter("rgba IS NOT NULL").withColumns({"layer_ord": F.col("rgba.a"), "fid": F.lit(None).cast(lines.schema["fid"].dataType), "rgba": color(0, 0, 0, 0)}).dropDuplicates()
    marks = drawn(below).withColumn("low", F.col("layer_ord")).withColumn("layer_ord", F.lit(None).cast(lines.schema["layer_ord"].dataType))
    return folded(drawn(lines), drawn(last).withColumn("low", F.lit(-1)).unionByName(marks))


def overwrite(pixels: DataFrame) -> DataFrame:
    """(canvas, px, py, rgba): the last in paint order, nothing blended; partial sums, so hot pixels are no matter.

    The last of each layer comes first, a colour as two numbers, so that rows are hashed and not
    sorted where fid is a number. Null orders lie below all others.
    """
    half, low = 1 << 32, 1 << 31
    whole = lambda c: F.coalesce(F.col(f"rgba.{c}").cast("long"), F.lit(-low))
    two = lambda p, q: F.when(F.col("rgba").isNotNull(), whole(p) * half + whole(q) + low)
    number = isinstance(pixels.schema["fid"].dataType, T.NumericType)
    order = F.coalesce("fid", F.lit(0).cast(pixels.schema["fid"].dataType)) if number else F.struct("fid")
    flat = pixels.select("canvas", "px", "py", "layer_ord", F.col("fid").isNotNull().alias("_some"), order.alias("_order"), two("r", "g").alias("_rg"), two("b", "a").alias("_ba"))
    layers = flat.groupBy("canvas", "px", "py", "layer_ord", "_some").agg(F.max_by("_rg", "_order").alias("_rg"), F.max_by("_ba", "_order").alias("_ba"))
    top = layers.groupBy("canvas", "px", "py").agg(F.max_by(F.struct("_rg", "_ba"), F.struct("layer_ord", "_some")).alias("_top"))
    part = lambda v: F.nullif(v.cast("int"), F.lit(-low).cast("int"))
    first, second = (lambda v: part(F.shiftright(v, 32))), (lambda v: part(F.pmod(v, F.lit(half)) - low))
    rg, ba = F.col("_top._rg"), F.col("_top._ba")
    return top.select("canvas", "px", "py", F.when(rg.isNotNull(), color(first(rg), second(rg), first(ba), second(ba))).alias("rgba"))


def icon(shape: str, size: int) -> list[tuple[int, int]]:
    """Pixels of a small shape: circle, square, diamond, triangle or star, within size x size."""
    c, r = (size - 1) / 2, size / 2
    inside = {
        "circle": lambda x, y: (x - c) ** 2 + (y - c) ** 2 <= r * r,
        "square": lambda x, y: True,
        "diamond": lambda x, y: abs(x - c) + abs(y - c) <= r,
        "triangle": lambda x, y: abs(x - c) <= y / 2 + 0.5,
        "star": lambda x, y: _in_star(x - c, y - c, r),
    }
    if shape not in inside or size < 1:
        raise ValueError("unknown shape or size")
    return [(x, y) for y in range(size) for x in range(size) if inside[shape](x, y)]


def _in_star(x: float, y: float, r: float) -> bool:
    from math import atan2, cos, hypot, pi

    turn = (atan2(x, -y) % (2 * pi / 5)) - pi / 5
    return hypot(x, y) * cos(abs(turn)) <= r * 0.4 * (1 + abs(turn))


def stamps(points: DataFrame, pixels: list[tuple[int, int]], size: int, width: int, height: int, anchor: str = "center") -> DataFrame:
    """Points (keys, x, y, rgba) stamped with an icon's pixels at one of nine anchors."""
    dx = 0 if "left" in anchor else size if "right" in anchor else size / 2
    dy = 0 if "top" in anchor else size if "bottom" in anchor else size / 2
    table = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pixels]))
    rows = points.withColumn("_p", table)
    px, py = (F.col("x") - dx).cast("int") + F.col("_p.x"), (F.col("y") - dy).cast("int") + F.col("_p.y")
    return rows.select(*KEYS, px.alias("px"), py.alias("py"), "rgba").filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def _icon_pixels(b: pa.RecordBatch, width: int, height: int) -> Iterator[pa.RecordBatch]:
    """The pixels of placed icons with the place u, v in the icon that each shows."""
    x, y, s, turn, iw, ih, w, h, x0, y0, sin, cos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y", "_s", "_turn", "_iw", "_ih", "_w", "_h", "_x0", "_y0", "_sin", "_cos"))
    straight = turn == 0
    # the box of the turned corners
    xs, ys = [], []
    for right in (0, 1):
        for low in (0, 1):
            rx, ry = x0 + w * right - x, y0 + h * low - y
            xs.append(np.where(straight, x0 + w * right, x + rx * cos - ry * sin))
            ys.append(np.where(straight, y0 + h * low, y + rx * sin + ry * cos))
    sound = np.isfinite(np.sum(xs, axis=0) + np.sum(ys, axis=0))
    clip = lambda v, n: np.clip(np.where(sound, v, -1), -1, n).astype(np.int64)
    ax, bx = np.maximum(clip(np.floor(np.min(xs, axis=0)), width), 0), np.minimum(clip(np.ceil(np.max(xs, axis=0)) - 1, width), width - 1)
    ay, by = np.maximum(clip(np.floor(np.min(ys, axis=0)), height), 0), np.minimum(clip(np.ceil(np.max(ys, axis=0)) - 1, height), height - 1)
    whose, py = _ranges(ay, np.where(bx >= ax, np.maximum(by - ay + 1, 0), 0))
    across = (bx - ax + 1)[whose]
    for at in _slices(across, PIXELS):
        i, px = _ranges(ax[whose[at]], across[at])
        line, i = py[at][i], whose[at][i]
        rx, ry = px + 0.5 - x[i], line + 0.5 - y[i]
        lx = np.where(straight[i], px - x0[i], x[i] + rx * cos[i] + ry * sin[i] - x0[i])
        ly = np.where(straight[i], line - y0[i], y[i] - rx * sin[i] + ry * cos[i] - y0[i])
        on = (lx >= 0) & (ly >= 0) & (lx < w[i]) & (ly < h[i])
        i, lx, ly = i[on], lx[on], ly[on]
        own = pa.array(i)
        u, v = np.minimum(np.floor(lx / s[i]), iw[i] - 1), np.minimum(np.floor(ly / s[i]), ih[i] - 1)
        cells = [pa.array(c.astype(np.int32)) for c in (px[on], line[on], u, v)]
        yield pa.RecordBatch.from_arrays([*[b.column(k).take(own) for k in (*KEYS, "icon")], *cells], names=[*KEYS, "icon", "px", "py", "u", "v"])


def _slices(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of n whose sums are at most `most`, or one entry."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + most, side="right")), at + 1)
        yield slice(at, to)
        at = to


def icons(points: DataFrame, atlas: DataFrame, width: int, height: int, anchor: str = "center") -> DataFrame:
    """Points (keys, x, y, icon, scale, rotation in degrees, dx, dy) as the pixels of their icons.

    atlas (icon, u, v, rgba) has a row for each pixel of each icon; an icon is as large as its
    greatest u and v, and pixels without a row are clear. A point's target pixels are generated
    from the box of its turned icon and mapped back to the nearest pixel of it; these meet the atlas
    by an equi-join, so a common icon spreads over its pixels. The atlas is written first: a small one
    is known to be small and its joins need no shuffle of the pixels. dx and dy move the anchor, about
    which the icon turns. A null scale is 1, other nulls of size, turn and offset are 0; points
    without a place, of an unknown icon or of a size below one pixel draw nothing.
    """
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")
    atlas = kept(atlas.select("icon", "u", "v", "rgba"))
    sizes = kept(atlas.filter("icon IS NOT NULL").groupBy("icon").agg((F.max("u") + 1).alias("_iw"), (F.max("v") + 1).alias("_ih")))
    placed = spread(points.filter("x IS NOT NULL AND y IS NOT NULL"), *KEYS).select(*KEYS, "icon", (F.col("x") + F.coalesce("dx", F.lit(0.0))).alias("_x"), (F.col("y") + F.coalesce("dy", F.lit(0.0))).alias("_y"), F.coalesce("scale", F.lit(1.0)).alias("_s"), F.radians(F.coalesce("rotation", F.lit(0.0))).alias("_turn"))
    placed = placed.join(sizes, "icon").withColumns({"_w": whole(F.col("_iw") * F.col("_s")), "_h": whole(F.col("_ih") * F.col("_s"))}).filter("_w > 0 AND _h > 0")
    back_x = F.lit(0.0) if "left" in anchor else F.col("_w") if "right" in anchor else F.floor(F.col("_w") / 2)
    back_y = F.lit(0.0) if "top" in anchor else F.col("_h") if "bottom" in anchor else F.floor(F.col("_h") / 2)
    placed = placed.withColumns({"_x0": whole(F.col("_x")) - back_x, "_y0": whole(F.col("_y")) - back_y, "_sin": F.sin("_turn"), "_cos": F.cos("_turn")})
    numbers = ["_x", "_y", "_s", "_turn", "_iw", "_ih", "_w", "_h", "_x0", "_y0", "_sin", "_cos"]
    own = placed.select(*KEYS, "icon", *[F.col(c).cast("double").alias(c) for c in numbers])
    schema = T.StructType([*[f for f in own.schema.fields if f.name not in numbers], *[T.StructField(k, T.IntegerType()) for k in ("px", "py", "u", "v")]])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _icon_pixels(b, width, height)

    rows = own.mapInArrow(drawn, schema)
    return rows.join(atlas.select("icon", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "rgba"), ["icon", "u", "v"]).select(*KEYS, "px", "py", "rgba")


def extrude(ring: Column, height: float = 10.0, light: float = 0.7853981633974483, intensity: float = 0.6, scale: float = 0.5) -> Column:
    """struct<top, walls>: a ring moved along the light, and its walls as rings with a shade of 0.4 to 1."""
    import math

    mx, my = math.cos(light) * height * scale, -math.sin(light) * height * scale
    move = lambda p: F.struct((p["x"] + mx).alias("x"), (p["y"] + my).alias("y"))
    n = F.size(ring)

    def wall(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        facing = F.cos(F.atan2(b["y"] - a["y"], b["x"] - a["x"]) + math.pi / 2 - light)
        shade = F.lit(0.4) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), facing * intensity)) * 0.6
        return F.struct(F.array(a, b, move(b), move(a)).alias("ring"), shade.alias("shade"), ((a["y"] + b["y"]) / 2.0).alias("mean_y"))

    walls = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), wall), lambda p, q: F.when(p["mean_y"] < q["mean_y"], -1).when(p["mean_y"] > q["mean_y"], 1).otherwise(0))
    return F.struct(F.transform(ring, move).alias("top"), walls.alias("walls"))


def to_bytes(blended: DataFrame, width: int, height: int) -> DataFrame:
    """(canvas, py, row): each pixel row as width * 4 bytes, transparent where nothing is. A row fits a task whatever the canvas."""
    part = lambda c: F.lpad(F.hex(c), 2, "0")
    text = F.concat(*[part(F.col(f"rgba.{c}")) for c in "rgba"])
    rows = blended.groupBy("canvas", "py").agg(F.map_from_entries(F.collect_list(F.struct("px", text.alias("t")))).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit("00000000")))
    return rows.select("canvas", "py", F.unhex(F.array_join(line, "")).alias("row"))
