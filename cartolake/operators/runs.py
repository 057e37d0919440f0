"""Canvases of few shapes drawn whole by one task, as runs of pixels of one colour.

Shapes are dealt by canvas, not their pixels. A task draws each distinct shape of a batch once, cuts
the rows of a canvas where runs begin and end, and folds the stack of each piece. Canvases of many
shapes are told apart before; their pixels are blended in sorted streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.operators.raster import BAND, KEYS, PIXELS, _ranges, _slices, _spans, _stroked
from cartolake.operators.scratch import kept, spread
from cartolake.operators.stacks import _RGBA, CHANNELS, _fold

DISC, FILL, STROKE = 0, 1, 2
CAPS = ("butt", "round", "square")
#: Shapes of a canvas that one task draws; canvases with more are blended pixel by pixel.
SHAPES = 4096
#: Hash values of canvases that are counted first, so that most canvases need no count of their own.
BUCKETS = 1 << 16


def crowded(canvases: DataFrame) -> DataFrame | None:
    """(canvas) with more than SHAPES rows, written; None if there is none."""
    bucket = F.pmod(F.xxhash64("canvas"), F.lit(BUCKETS))
    full = kept(canvases.groupBy(bucket.alias("_bucket")).count().filter(F.col("count") > SHAPES).select("_bucket"))
    if not full.limit(1).count():
        return None
    own = canvases.withColumn("_bucket", bucket).join(F.broadcast(full), "_bucket", "left_semi")
    many = kept(own.groupBy("canvas").count().filter(F.col("count") > SHAPES).select(F.col("canvas").alias("_canvas")))
    return many if many.limit(1).count() else None


def drawn(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """(canvas, py, a, b, rgba): runs of pixels a to b of shapes (canvas, layer_ord, fid, rgba, solid, role, size, cap, paths), blended in paint order.

    size is a radius or a width; paths (part, pts) lie on the screen. A canvas is at most BAND pixels
    high, and a task holds the shapes of one: crowded ones are for blend.
    """
    if height > BAND:
        raise ValueError("a canvas is too high for one task")
    hashed = [h.alias(k) for k, h in (("_h1", F.xxhash64("role", "size", "cap", "paths")), ("_h2", F.xxhash64(F.lit("second"), "role", "size", "cap", "paths")))]
    colours = [F.col(f"rgba.{c}").alias(c) for c in CHANNELS]
    rows = shapes.filter("rgba IS NOT NULL").select(*KEYS, *colours, "solid", F.col("role").cast("int").alias("role"), F.col("size").cast("double").alias("size"), F.col("cap").cast("int").alias("cap"), "paths", *hashed)
    rows = spread(rows, "canvas").sortWithinPartitions(*KEYS, *CHANNELS, "solid")
    schema = T.StructType([rows.schema["canvas"], *[T.StructField(c, T.IntegerType()) for c in ("py", "a", "b")], T.StructField("rgba", _RGBA)])
    return rows.mapInArrow(lambda batches: _canvases(batches, width, height), schema)


def _canvases(batches: Iterator[pa.RecordBatch], width: int, height: int) -> Iterator[pa.RecordBatch]:
    """Whole canvases of sorted shapes, as they come."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        canvas = _codes(b)
        last = int(np.searchsorted(canvas, canvas[-1]))  # its canvas may go on
        if last:
            yield from _blended(b.slice(0, last), canvas[:last], width, height)
        rest = b.slice(last)
    if rest is not None:
        yield from _blended(rest, _codes(rest), width, height)


def _codes(b: pa.RecordBatch) -> np.ndarray:
    """Numbers from 0 of sorted canvases, null first as any other."""
    codes = b.column("canvas").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.cumsum(np.append(False, codes[1:] != codes[:-1]))


def _blended(b: pa.RecordBatch, canvas: np.ndarray, width: int, height: int) -> Iterator[pa.RecordBatch]:
    h1, h2 = (b.column(c).to_numpy() for c in ("_h1", "_h2"))
    order = np.lexsort((h2, h1))
    new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
    kind = np.empty(b.num_rows, np.int64)
    kind[order] = np.cumsum(new) - 1
    whose, line, low, high, apart = _shapes(b.take(pa.array(order[new])), width, height)
    begins = np.searchsorted(whose, np.arange(int(new.sum()) + 1))
    shape, at = _ranges(begins[kind], begins[kind + 1] - begins[kind])
    line, low, high = line[at], low[at], high[at]
    rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in CHANNELS], axis=1).astype(np.int32)
    solid = b.column("solid").to_numpy(zero_copy_only=False).astype(bool)
    n = np.arange(b.num_rows)
    alone = (np.bincount(canvas)[canvas] == 1) & apart[kind]

    def out(own: np.ndarray, line: np.ndarray, low: np.ndarray, high: np.ndarray, colours: np.ndarray) -> pa.RecordBatch:
        rgba = pa.StructArray.from_arrays([pa.array(colours[:, i]) for i in range(4)], names=list(CHANNELS))
        return pa.RecordBatch.from_arrays([b.column("canvas").take(pa.array(own)), *[pa.array(v.astype(np.int32)) for v in (line, low, high)], rgba], names=["canvas", "py", "a", "b", "rgba"])

    one = alone[shape]
    if one.any():
        # a shape by itself: nothing lies on another
        colours = _fold(rows, solid, n, np.ones_like(n))
        yield out(shape[one], line[one], low[one], high[one], colours[shape[one]])
    if one.all():
        return
    leader = _lines(b, canvas)
    several = np.bincount(leader, minlength=len(n)) > 1
    shape, line, low, high = (v[~one] for v in (shape, line, low, high))
    shape = leader[shape]
    row = canvas[shape] * height + line
    order = np.argsort(row, kind="stable")
    shape, row, low, high = (v[order] for v in (shape, row, low, high))
    first, end = row * (width + 1) + low, row * (width + 1) + high + 1
    cuts = np.unique(np.append(first, end))
    piece, until = np.searchsorted(cuts, first), np.searchsorted(cuts, end)
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    tails = np.append(heads[1:], len(row))
    for some in _slices(np.add.reduceat(until - piece, heads), PIXELS):
        part = slice(heads[some][0], tails[some][-1])
        own, pieces = _ranges(piece[part], (until - piece)[part])
        own = shape[part][own]
        order = np.lexsort((own, pieces))
        own, pieces = own[order], pieces[order]
        again = np.append(False, (own[1:] == own[:-1]) & (pieces[1:] == pieces[:-1])) & several[own]
        own, pieces = own[~again], pieces[~again]
        starts = np.flatnonzero(np.append(True, pieces[1:] != pieces[:-1]))
        colours = _fold(rows[own], solid[own], starts, np.diff(np.append(starts, len(pieces))))
        begin, over = cuts[pieces[starts]], cuts[pieces[starts] + 1]
        yield out(own[starts], begin // (width + 1) % height, begin % (width + 1), over - begin + begin % (width + 1) - 1, colours)


def _lines(b: pa.RecordBatch, canvas: np.ndarray) -> np.ndarray:
    """For each shape the one that it is a layer with: the first stroke of its canvas, layer_ord and fid; else itself."""
    other = np.append(True, canvas[1:] != canvas[:-1])
    for k in ("layer_ord", "fid"):
        code = b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        other[1:] |= code[1:] != code[:-1]
    group = np.cumsum(other) - 1
    leader = np.arange(b.num_rows)
    strokes = np.flatnonzero(b.column("role").to_numpy() == STROKE)
    _, first, of = np.unique(group[strokes], return_index=True, return_inverse=True)
    leader[strokes] = strokes[first[of]]
    return leader


def _shapes(b: pa.RecordBatch, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shape, line, first and last pixel of each run of the shapes, by shape, and which shapes have no run over another."""
    role, size, cap = (b.column(c).to_numpy(zero_copy_only=False) for c in ("role", "size", "cap"))
    paths = b.column("paths")
    owner, flat = pc.list_parent_indices(paths).to_numpy(), paths.flatten()
    part, pts = flat.field("part").to_numpy(zero_copy_only=False), flat.field("pts")
    apart = np.ones(b.num_rows, bool)
    found = [np.zeros((4, 0), np.int64)]

    mine = np.flatnonzero(role[owner] == FILL)
    if len(mine):
        mine = mine[np.lexsort((part[mine], owner[mine]))]
        new = np.append(True, (owner[mine][1:] != owner[mine][:-1]) | (part[mine][1:] != part[mine][:-1]))
        of = owner[mine][new]
        rings = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(mine)).astype(np.int32)), pts.take(pa.array(mine)))
        polygon, line, low, n = _spans(rings, width, height, 1)
        found.append(np.stack([of[polygon], line, low, low + n - 1])[:, n > 0])
        apart[np.flatnonzero(np.bincount(of, minlength=b.num_rows) > 1)] = False

    points = pts.flatten()
    x, y = (v.to_numpy(zero_copy_only=False).astype(np.float64) for v in points.flatten()[:2])
    of = np.repeat(np.arange(len(owner)), pc.fill_null(pc.list_value_length(pts), 0).to_numpy())
    mine = np.flatnonzero(role[owner[of]] == DISC)
    if len(mine):
        of_disc = owner[of[mine]]
        cx, cy, r = (np.trunc(v) for v in (x[mine], y[mine], size[of_disc]))
        sound = np.isfinite(cx + cy + r) & (np.abs(cx) + np.abs(r) < 1 << 30) & (np.abs(cy) + np.abs(r) < 1 << 30)
        cx, cy, r = (np.where(sound, v, -1).astype(np.int64) for v in (cx, cy, r))
        top = np.maximum(cy - r, 0)
        i, line = _ranges(top, np.where(r >= 0, np.maximum(np.minimum(cy + r, height - 1) - top + 1, 0), 0))
        half = np.floor(np.sqrt((r[i] ** 2 - (line - cy[i]) ** 2).astype(np.float64))).astype(np.int64)
        low, high = np.maximum(cx[i] - half, 0), np.minimum(cx[i] + half, width - 1)
        found.append(np.stack([of_disc[i], line, low, high])[:, low <= high])
        apart[np.flatnonzero(np.bincount(of_disc, minlength=b.num_rows) > 1)] = False

    mine = np.flatnonzero(role[owner[of]] == STROKE)
    if len(mine):
        path = of[mine]
        start = np.flatnonzero(path[1:] == path[:-1])
        inner = start[1:][path[start[1:] - 1] == path[start[1:]]] if len(start) else start
        a, z = np.append(mine[start], mine[inner]), np.append(mine[start + 1], mine[inner])
        joint = np.append(np.zeros(len(start), bool), np.ones(len(inner), bool))
        order = np.argsort(owner[of[a]], kind="stable")
        a, z, joint = a[order], z[order], joint[order]
        line_of = owner[of[a]]
        zero = pa.array(np.zeros(len(a), np.int32))
        numbers = [pa.array(v) for v in (x[a], y[a], x[z], y[z], size[line_of], joint | (cap[line_of] == 1), ~joint & (cap[line_of] == 2))]
        segs = pa.RecordBatch.from_arrays([pa.array(line_of), zero, zero, zero, zero, *numbers], names=[*KEYS, "rgba", "_band", "x0", "y0", "x1", "y1", "line_width", "_round", "_square"])
        for pixels in _stroked(iter([segs]), width, height, 0.0):
            own, px, py = (pixels.column(c).to_numpy().astype(np.int64) for c in ("canvas", "px", "py"))
            new = np.append(True, (own[1:] != own[:-1]) | (py[1:] != py[:-1]) | (px[1:] != px[:-1] + 1)) if len(px) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            found.append(np.stack([own[head], py[head], px[head], px[np.append(head[1:], len(px)) - 1]]))

    whose, line, low, high = np.concatenate(found, axis=1)
    order = np.argsort(whose, kind="stable")
    return whose[order], line[order], low[order], high[order], apart
