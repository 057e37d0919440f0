"""Stacks of colours folded in paint order, as sorted streams.

Rows lie in ranges of canvas, place and order, so a pixel with any number of layers spreads over
tasks and a task holds one colour of it. Colours are whole bytes after each layer, so a fold can't
be regrouped; what a task can say of a pixel that began before its range is the fold as a function
of the colour it starts from. Functions of alpha and one channel have 65,536 arguments and soon few
values; a last step for each pixel on a border applies them in order. Few pixels come so far: mostly
the last layers of a pixel give its colour whatever lies below them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.operators.scratch import kept, spread

CHANNELS = ("r", "g", "b", "a")
#: Layers after which a function's equal values are put together.
MERGE_EVERY = 4
#: Values of a function, or stacks of a batch, that are folded one by one instead of as arrays.
FEW = 24
#: Last layers of a pixel that are tried before all of them.
TOP = 32
#: Rows that a task takes together to find the last layers of its pixels.
CHUNK = 1 << 20
_RGBA = T.StructType([T.StructField(c, T.IntegerType()) for c in CHANNELS])


def _step(value: np.ndarray, alpha: np.ndarray, top: np.ndarray, top_alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Channel and alpha of a colour over another, in double precision, cut to whole numbers; nothing over nothing is all 0."""
    a, b = top_alpha / 255.0, alpha / 255.0
    out = a + b * (1.0 - a)
    safe = np.where(out > 0, out, 1.0)
    mixed = (top / 255.0 * a + value / 255.0 * b * (1.0 - a)) / safe * 255.0
    return np.where(out > 0, np.clip(mixed, 0, 255), 0).astype(np.int32), np.clip(out * 255.0, 0, 255).astype(np.int32)


def _run(value: int, alpha: int, tops: list[int], alphas: list[int]) -> tuple[int, int]:
    """The same for one colour and many layers, one after another."""
    for top, top_alpha in zip(tops, alphas, strict=True):
        a, b = top_alpha / 255.0, alpha / 255.0
        out = a + b * (1.0 - a)
        if out > 0:
            value, alpha = int(min(255.0, (top / 255.0 * a + value / 255.0 * b * (1.0 - a)) / out * 255.0)), int(min(255.0, out * 255.0))
        else:
            value = alpha = 0
    return value, alpha


class _Open:
    """A pixel whose layers are still coming: a colour, or for each channel its values and alphas and where each start leads."""

    def __init__(self, key: tuple, head: bool) -> None:
        self.key, self.first, self.layers = key, head, 0
        self.colour = np.zeros(4, np.int32)
        start = np.arange(65536, dtype=np.int32)
        self.functions = [[start & 255, start >> 8, start] for _ in range(3)] if head else None

    def add(self, rows: np.ndarray, solid: np.ndarray) -> None:
        """The rows (r, g, b, a) over it, from the last that hides all below it on."""
        hides = np.flatnonzero(solid | (rows[:, 3] == 255))
        if len(hides):
            self.functions, self.colour = None, np.zeros(4, np.int32)
            rows, solid = rows[hides[-1] :], solid[hides[-1] :]
            if solid[0]:
                self.colour, rows = rows[0].astype(np.int32), rows[1:]
        done = self._narrowed(rows) if self.functions else 0
        alphas = rows[done:, 3].tolist()
        tops = [rows[done:, c].tolist() for c in range(3)]
        if self.functions is None:
            ends = [_run(int(self.colour[c]), int(self.colour[3]), tops[c], alphas) for c in range(3)]
            self.colour = np.array([*[e[0] for e in ends], ends[0][1]], np.int32)
        elif alphas:
            for c, f in enumerate(self.functions):
                ends = [_run(v, a, tops[c], alphas) for v, a in zip(f[0].tolist(), f[1].tolist(), strict=True)]
                f[0], f[1] = (np.array(e, np.int32) for e in zip(*ends, strict=True))
            self._merge()

    def _narrowed(self, rows: np.ndarray) -> int:
        """How many of the rows the functions took as arrays before few values were left."""
        for i, row in enumerate(rows):
            if self.functions is None or sum(len(f[0]) for f in self.functions) <= FEW:
                return i
            for c, f in enumerate(self.functions):
                f[0], f[1] = _step(f[0], f[1], row[c], row[3])
            self.layers += 1
            if self.layers % MERGE_EVERY == 0:
                self._merge()
        return len(rows)

    def _merge(self) -> None:
        """Equal values together; functions of one value are a colour."""
        for f in self.functions:
            ends, where = np.unique(f[1] * 256 + f[0], return_inverse=True)
            f[0], f[1], f[2] = ends & 255, ends >> 8, where.astype(np.int32)[f[2]]
        if all(len(f[0]) == 1 for f in self.functions):
            self.colour = np.array([*[f[0][0] for f in self.functions], self.functions[0][1][0]], np.int32)
            self.functions = None

    def piece(self) -> bytes | None:
        """The functions as bytes: for each channel, alpha and value that each start leads to."""
        if self.functions is None:
            return None
        return zlib.compress(b"".join((f[1] * 256 + f[0]).astype("<u2")[f[2]].tobytes() for f in self.functions), 1)


def _fold(rows: np.ndarray, solid: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The colours of whole stacks that lie one after another, one layer of all at a time."""
    place = np.arange(len(rows)) - np.repeat(starts, sizes)
    hides = solid | (rows[:, 3] == 255)
    below = np.maximum.reduceat(np.where(hides, place, 0), starts)
    first, left = starts + below, sizes - below
    order = np.argsort(-left, kind="stable")
    first, left = first[order], left[order]
    out = np.zeros((len(starts), 4), np.int32)
    for layer in range(int(left[0])):
        n = int(np.searchsorted(-left, -layer, side="left"))
        if layer and n <= FEW:  # only the first layer can be solid
            for i in range(n):
                rest = rows[first[i] + layer : first[i] + left[i]]
                alphas = rest[:, 3].tolist()
                ends = [_run(int(out[i, c]), int(out[i, 3]), rest[:, c].tolist(), alphas) for c in range(3)]
                out[i] = [*[e[0] for e in ends], ends[0][1]]
            break
        at = first[:n] + layer
        top = rows[at]
        value, alpha = _step(out[:n, :3], out[:n, 3:], top[:, :3], top[:, 3:])
        out[:n] = np.where(solid[at][:, None], top, np.hstack([value, alpha]))
    back = np.empty_like(out)
    back[order] = out
    return back


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole stacks as colours; the first and the last of the range as pieces, with the number of the range."""
    opened: _Open | None = None
    part, kind, first = None, None, True

    def pieces(p: _Open) -> pa.RecordBatch:
        colour = [dict(zip(CHANNELS, map(int, p.colour), strict=True))]
        columns = [pa.array([p.key[0]], kind), *[pa.array([v], pa.int32()) for v in p.key[1:]], pa.array(colour, pa.struct([(c, pa.int32()) for c in CHANNELS])), pa.array([part], pa.int32()), pa.array([p.first]), pa.array([p.piece()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["canvas", "px", "py", "rgba", "part", "first", "piece"])

    for b in batches:
        if not b.num_rows:
            continue
        part, kind = b.column("part")[0].as_py(), b.schema.field("canvas").type
        canvas, px, py = b.column("canvas"), b.column("px").to_numpy(zero_copy_only=False), b.column("py").to_numpy(zero_copy_only=False)
        codes = canvas.dictionary_encode().indices.fill_null(-1).to_numpy()
        rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in CHANNELS], axis=1).astype(np.int32)
        solid = b.column("solid").to_numpy(zero_copy_only=False).astype(bool)
        new = np.flatnonzero((codes[1:] != codes[:-1]) | (px[1:] != px[:-1]) | (py[1:] != py[:-1])) + 1
        starts = np.append(0, new)
        ends = np.append(new, b.num_rows)
        key = lambda i: (canvas[int(i)].as_py(), int(px[i]), int(py[i]))
        if opened is None:
            opened = _Open(key(0), head=True)
        if opened.key == key(0):
            opened.add(rows[: ends[0]], solid[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        if len(starts):
            yield pieces(opened)
            if len(starts) > 1:
                a, z = int(starts[0]), int(starts[-1])
                colours = _fold(rows[a:z], solid[a:z], starts[:-1] - a, (ends - starts)[:-1])
                n = len(colours)
                at = pa.array(starts[:-1])
                rgba = pa.StructArray.from_arrays([pa.array(colours[:, i]) for i in range(4)], names=list(CHANNELS))
                columns = [canvas.take(at), b.column("px").take(at), b.column("py").take(at), rgba, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["canvas", "px", "py", "rgba", "part", "first", "piece"])
            opened = _Open(key(starts[-1]), head=False)
            opened.add(rows[starts[-1] :], solid[starts[-1] :])
    if opened is not None:
        yield pieces(opened)


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """One pixel's pieces in order, each a colour or a function of the colour before it."""
    colour = [0, 0, 0, 0]
    for row in pieces.sort_values(["part", "first"], ascending=[True, False]).itertuples():
        if row.piece is None:
            colour = [int(row.rgba[c]) for c in CHANNELS]
        else:
            ends = np.frombuffer(zlib.decompress(row.piece), "<u2").reshape(3, 65536)
            ends = [int(ends[i][colour[3] * 256 + colour[i]]) for i in range(3)]
            colour = [*[e & 255 for e in ends], ends[0] >> 8]
    out = pieces[["canvas", "px", "py"]].head(1).copy()
    out["rgba"] = [dict(zip(CHANNELS, colour, strict=True))]
    return out


@lru_cache(maxsize=1)
def _caps() -> np.ndarray:
    """The most alpha that layers of at most each alpha can come to; 255 only over an opaque one."""
    alphas, out = np.arange(255), np.zeros(256, np.int32)
    for most in alphas:
        alpha, tops = 0, alphas[: most + 1] / 255.0
        while (more := int(np.clip((tops + alpha / 255.0 * (1.0 - tops)) * 255.0, 0, 255).astype(np.int32).max())) > alpha:
            alpha = more
        out[most] = alpha
    out[255] = 255
    return out


def _constant(rows: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether layers (stack, layer, channel) end in one colour whatever lies below them, of alphas up to low: bounds of channels and alpha are carried up."""
    a0, a1 = np.zeros(len(rows), np.int32), _caps()[low]
    bounds = [(np.zeros(len(rows), np.int32), np.full(len(rows), 255, np.int32)) for _ in range(3)]
    slack = 1e-6
    for layer in range(rows.shape[1]):
        a = rows[:, layer, 3] / 255.0
        outs = [a + b / 255.0 * (1.0 - a) for b in (a0, a1)]
        for c in range(3):
            ends = [np.where(out > 0, (rows[:, layer, c] / 255.0 * a + v / 255.0 * (b / 255.0) * (1.0 - a)) / np.where(out > 0, out, 1.0) * 255.0, 0) for v in bounds[c] for b, out in zip((a0, a1), outs, strict=True)]
            bounds[c] = tuple(np.clip(e, 0, 255).astype(np.int32) for e in (np.min(ends, axis=0) - slack, np.max(ends, axis=0) + slack))
        a0, a1 = (np.clip(out * 255.0 + d, 0, 255).astype(np.int32) for out, d in zip(outs, (-slack, slack), strict=True))
        # an alpha on a whole number is not moved by the slack that bounds it
        exact = outs[0] == outs[1]
        a0 = np.where(exact, np.clip(outs[0] * 255.0, 0, 255).astype(np.int32), a0)
        a1 = np.where(exact, a0, a1)
    return (a0 == a1) & np.logical_and.reduce([lo == hi for lo, hi in bounds])


def _rank(column: pa.Array) -> np.ndarray:
    """Numbers in the order of a column, nulls first."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _trimmed(b: pa.Table) -> tuple[pa.Table, bool]:
    """The last TOP rows of each pixel from one that hides all below it on, and whether any were cut. `low` tells the most alpha that was cut."""
    b = b.combine_chunks()
    column = lambda k: b.column(k).chunk(0) if b.num_rows else pa.array([], b.schema.field(k).type)
    canvas = column("canvas").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    place = column("py").to_numpy(zero_copy_only=False).astype(np.int64) << 32 | column("px").to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
    alpha, solid = column("a").to_numpy(zero_copy_only=False), column("solid").to_numpy(zero_copy_only=False).astype(bool)
    order = [solid, alpha, *[column(c).to_numpy(zero_copy_only=False) for c in "bgr"], _rank(column("fid")), _rank(column("layer_ord")), place, canvas]
    moving = [k for k in order if len(k) and (k != k[0]).any()]
    by = np.lexsort(moving) if moving else np.arange(b.num_rows)
    canvas, place = canvas[by], place[by]
    last = np.append((canvas[1:] != canvas[:-1]) | (place[1:] != place[:-1]), True)
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends - starts + 1
    at = np.arange(b.num_rows)
    depth = np.repeat(ends, sizes) - at
    hides = (solid | (alpha == 255))[by]
    top_hide = np.maximum.reduceat(np.where(hides, at, -1), starts)
    keep = (depth < TOP) & (at >= np.repeat(top_hide, sizes))
    if keep.all():
        return b, False
    # what a kept row hides never counts; what is cut for its depth does
    cut = (depth >= TOP) & (at >= np.repeat(top_hide, sizes))
    low = column("low").to_numpy(zero_copy_only=False)[by]
    least = np.maximum.reduceat(np.maximum(low, np.where(cut, np.where(hides, 255, alpha[by]), -1)), starts)
    low = np.where(last, np.repeat(least, sizes), low)[keep].astype(np.int32)
    out = b.take(pa.array(by[keep]))
    where = out.schema.get_field_index("low")
    return out.set_column(where, out.schema.field(where), pa.array(low)), True


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has of the last layers of its pixels; where few are cut, rows pass for a while as they come."""
    held: list[pa.RecordBatch] = []
    rows, most, pass_ = 0, CHUNK, 0
    for b in batches:
        if pass_ > 0:
            pass_ -= b.num_rows
            yield b
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            table, cut = _trimmed(pa.Table.from_batches(held))
            if table.num_rows > 0.75 * rows:
                yield from table.to_batches(CHUNK >> 3)
                held, rows, most = [], 0, CHUNK
                pass_ = 0 if cut else 8 * CHUNK
            else:
                held, rows = table.to_batches(), table.num_rows
                most = rows + max(CHUNK, rows // 2)
                if most > 4 * CHUNK:
                    yield from table.to_batches(CHUNK >> 3)
                    held, rows, most = [], 0, CHUNK
    if held:
        yield from _trimmed(pa.Table.from_batches(held))[0].to_batches(CHUNK >> 3)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The colour of each pixel from its last layers, and whether what lies below them can't change it."""
    rest: pa.Table | None = None

    def told(b: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        rows = np.stack([b.column(c).to_numpy() for c in CHANNELS], axis=1).astype(np.int32)
        solid = b.column("solid").to_numpy().astype(bool)
        hides = solid | (rows[:, 3] == 255)
        at = np.arange(ends[-1])
        depth = np.repeat(ends, ends - starts) - 1 - at
        below = np.where(depth >= TOP, np.where(hides[: ends[-1]], 255, rows[: ends[-1], 3]), -1)
        low = np.maximum.reduceat(np.maximum(b.column("low").to_numpy()[: ends[-1]], below), starts)
        hidden = np.logical_or.reduceat(hides[: ends[-1]] & (depth < TOP), starts)
        ends, starts = ends, np.maximum(starts, ends - TOP)
        own = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
        pick = np.arange(int((ends - starts).sum())) - np.repeat(own, ends - starts) + np.repeat(starts, ends - starts)
        colours = _fold(rows[pick], solid[pick], own, ends - starts)
        sure = (low < 0) | hidden
        ask = np.flatnonzero(~sure)
        deep = ask[(ends - starts)[ask] == TOP]
        if len(deep):
            sure[deep] = _constant(rows[starts[deep][:, None] + np.arange(TOP)], low[deep])
        first = pa.array(starts)
        rgba = pa.StructArray.from_arrays([pa.array(colours[:, i]) for i in range(4)], names=list(CHANNELS))
        columns = [*[b.column(k).combine_chunks().take(first) for k in ("canvas", "px", "py")], rgba, pa.array(sure)]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=["canvas", "px", "py", "rgba", "sure"])

    for batch in batches:
        b = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        if not b.num_rows:
            continue
        codes = b.column("canvas").combine_chunks().dictionary_encode()
        codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        px, py = b.column("px").to_numpy(), b.column("py").to_numpy()
        starts = np.append(0, np.flatnonzero((codes[1:] != codes[:-1]) | (px[1:] != px[:-1]) | (py[1:] != py[:-1])) + 1)
        if len(starts) > 1:
            yield told(b, starts[:-1], starts[1:])
        rest = b.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield told(rest.combine_chunks(), np.array([0]), np.array([rest.num_rows]))


def uppermost(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of shapes (canvas, layer_ord, fid and what tells their pixels and colour) that are equal but for layer_ord and fid, the last TOP in paint order, and one shape for each more of them, where there are more.

    A pixel's last TOP layers are among the first's. Shapes are told by 128 bits of hashes; what is kept is written.
    """
    own = [c for c in shapes.columns if c not in ("layer_ord", "fid")]
    hashed = shapes.withColumns({"_h1": F.xxhash64(*own), "_h2": F.xxhash64(F.lit("second"), *own)})
    latest = Window.partitionBy("_h1", "_h2").orderBy(F.desc_nulls_last("layer_ord"), F.desc_nulls_last("fid"))
    ranked = kept(hashed.withColumn("_rank", F.dense_rank().over(latest)).filter(F.col("_rank") <= TOP + 1).drop("_h1", "_h2"))
    return ranked.filter(F.col("_rank") <= TOP).drop("_rank"), ranked.filter(F.col("_rank") > TOP).drop("_rank")


def folded(pixels: DataFrame, upper: DataFrame | None = None) -> DataFrame:
    """(canvas, px, py, rgba) of pixels (canvas, layer_ord, fid, px, py, rgba, solid): each pixel's colours one over another in paint order, null orders first.

    Solid rows take the pixel as they are; rows without a colour draw nothing. Each task keeps the
    last TOP layers of its pixels, which hold the last TOP of all; where these end in one colour
    whatever lies below, that is the pixel's. Pixels whose last layers leave it open are streamed
    whole. An empty table gives an empty one. upper: rows that hold the last TOP of each pixel, with
    a column `low`, the most alpha of what is left out on that pixel or -1.
    """
    order = ["canvas", "py", "px", "layer_ord", "fid", *CHANNELS, "solid"]
    plain = lambda rows, *more: rows.filter("rgba IS NOT NULL").select("canvas", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), "layer_ord", "fid", *[F.col(f"rgba.{c}").alias(c) for c in CHANNELS], "solid", *more)
    flat = plain(pixels)
    lower = flat.withColumn("low", F.lit(-1)) if upper is None else plain(upper, "low")
    place = T.StructType([T.StructField("canvas", pixels.schema["canvas"].dataType), T.StructField("px", T.IntegerType()), T.StructField("py", T.IntegerType()), T.StructField("rgba", _RGBA)])
    tops = spread(lower.mapInArrow(_tops, lower.schema), "canvas", "py", "px").sortWithinPartitions(*order).select("canvas", "px", "py", *CHANNELS, "solid", "low")
    told = kept(tops.mapInArrow(_settled, T.StructType([*place.fields, T.StructField("sure", T.BooleanType())])))
    whole = told.filter("sure").drop("sure")
    open_ = told.filter("NOT sure").select(*[F.col(c).alias(f"_{c}") for c in ("canvas", "px", "py")])
    if not open_.limit(1).count():
        return whole
    again = flat.join(open_, F.col("canvas").eqNullSafe(F.col("_canvas")) & (F.col("px") == F.col("_px")) & (F.col("py") == F.col("_py")), "left_semi")
    return whole.unionByName(_whole_stacks(again, place))


def _whole_stacks(flat: DataFrame, place: T.StructType) -> DataFrame:
    """All layers of each pixel in sorted ranges; rows equal in all columns stay in one range, streamed like any others."""
    order = ["canvas", "py", "px", "layer_ord", "fid", *CHANNELS, "solid"]
    ranges = flat.repartitionByRange(*order).sortWithinPartitions(*order).select("canvas", "px", "py", *CHANNELS, "solid", F.spark_partition_id().alias("part"))
    more = [T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("piece", T.BinaryType())]
    told = kept(ranges.mapInArrow(_streamed, T.StructType([*place.fields, *more])))
    whole = told.filter("part IS NULL").select("canvas", "px", "py", "rgba")
    return whole.unionByName(told.filter("part IS NOT NULL").groupBy("canvas", "px", "py").applyInPandas(_joined, place))
