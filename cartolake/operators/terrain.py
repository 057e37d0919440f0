"""Terrain: hillshade over a grid, elevation colours, contour classes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.values import byte, color
from cartolake.operators import grids
from cartolake.operators.scratch import kept


#: Fixed factors of Horn's slopes, by a neighbour's place relative to the cell.
HORN = {
    "dx": ((-1, -1, -1.0), (0, -1, -2.0), (1, -1, -1.0), (-1, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0)),
    "dy": ((-1, -1, -1.0), (-1, 0, -2.0), (-1, 1, -1.0), (1, -1, 1.0), (1, 0, 2.0), (1, 1, 1.0)),
}


def hillshade(dem: DataFrame, width: int, height: int, cell: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    """(row, col, shade 0..255) for a grid (row, col, elev): Horn's slopes over the 3 x 3 neighbourhood, 128 at the edges."""
    return shade_blocks(grids.blocks(dem), width, height, cell, azimuth, altitude, z_factor)


def shade_blocks(blocks: DataFrame, width: int, height: int, cell: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    """The same for a grid that is kept in blocks: only cells along block borders are shuffled."""
    zenith = math.radians(90.0 - altitude)
    direction = math.radians((360.0 - azimuth + 90.0) % 360.0)
    # the cell itself has no weight, but it is there if its height is
    got = grids.stencil(blocks, {**HORN, "own": ((0, 0, 0.0),)})
    got = got.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    scale = z_factor / (8.0 * cell)
    dx, dy = F.col("dx") * scale, F.col("dy") * scale
    slope = F.atan(F.sqrt(dx * dx + dy * dy))
    aspect = F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.atan2(dy, -dx))
    light = math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(F.lit(direction) - aspect)
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    return got.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.when(edge, 128).otherwise(byte(light * 255.0)).alias("shade"))


def shaded(rgba: Column, shade: Column, opacity: float) -> Column:
    """A colour under a shade: rgb * (1 - (1 - shade) * opacity), alpha as it is."""
    k = F.lit(1.0) - (F.lit(1.0) - shade / 255.0) * opacity
    return color(byte(rgba["r"] * k), byte(rgba["g"] * k), byte(rgba["b"] * k), rgba["a"])


#: Red, green and blue at the start of each quarter of the range, and their change over it.
HYPSOMETRIC = (((40, 150), (140, 70), (40, 20)), ((190, 50), (210, -60), (60, 20)), ((240, -40), (150, -50), (80, 50)), ((200, 55), (100, 155), (130, 125)))


def hypsometric(elev: Column, low: float, high: float) -> Column:
    """Elevation colour in four pieces; black for a range without extent."""
    if high == low:
        return color(0, 0, 0)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (elev - low) / (high - low)))
    quarter = F.least(F.floor(t * 4.0).cast("int"), F.lit(3))
    s = (t - quarter * 0.25) * 4.0
    channels = []
    for i in range(3):
        chain = F.lit(0.0)
        for q, piece in enumerate(HYPSOMETRIC):
            chain = F.when(quarter == q, F.lit(float(piece[i][0])) + s * float(piece[i][1])).otherwise(chain)
        channels.append(byte(chain))
    return color(*channels)


def contour_class(elev: Column, index_interval: float = 50.0, tolerance: float = 0.01) -> Column:
    """index for multiples of the index interval, else intermediate; just below a multiple is not one."""
    return F.when(F.abs(elev % index_interval) < tolerance, "index").otherwise("intermediate")


def _crossed(dem: DataFrame, interval: float) -> DataFrame:
    """(row, col, t, level): each triangle t of each cell, once for each level that its heights reach.

    A cell gets its corners from a stencil over blocks.
    """
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    got = grids.stencil(grids.blocks(dem), {f"e{i}": ((dr, dc, 1.0),) for i, (dr, dc) in enumerate(corners)}).filter("n = 4")
    got = got.withColumns({k: F.col(k).cast("int") for k in ("row", "col")})
    vertex = lambda i: F.struct((F.col("col") + corners[i][1]).cast("double").alias("x"), (F.col("row") + corners[i][0]).cast("double").alias("y"), F.col(f"e{i}").alias("e"))
    triangles = F.explode(F.array(F.array(vertex(0), vertex(1), vertex(2)), F.array(vertex(3), vertex(2), vertex(1))))
    rows = got.select("row", "col", triangles.alias("t"))
    heights = F.transform("t", lambda v: v["e"])
    first, last = F.ceil(F.array_min(heights) / interval), F.floor(F.array_max(heights) / interval)
    rows = rows.withColumn("level", F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))))
    return rows.withColumn("level", F.col("level") * float(interval))


def _on_edge(a: Column, b: Column) -> Column:
    """Where the level lies between two vertices."""
    s = (F.col("level") - a["e"]) / F.when(a["e"] != b["e"], b["e"] - a["e"]).otherwise(1.0)
    return F.struct((a["x"] + (b["x"] - a["x"]) * s).alias("x"), (a["y"] + (b["y"] - a["y"]) * s).alias("y"))


def contour_lines(dem: DataFrame, interval: float = 10.0, index_interval: float = 50.0) -> DataFrame:
    """(row, col, level, kind, x1, y1, x2, y2): the pieces of contour lines in each cell's two triangles.

    A level crosses a triangle between two edges.
    """

    def crossing(i: int, j: int) -> Column:
        a, b = F.get("t", F.lit(i)), F.get("t", F.lit(j))
        return F.when((a["e"] < F.col("level")) != (b["e"] < F.col("level")), _on_edge(a, b))

    hits = F.filter(F.array(crossing(0, 1), crossing(1, 2), crossing(2, 0)), lambda h: h.isNotNull())
    rows = _crossed(dem, interval).withColumn("h", hits).filter(F.size("h") == 2)
    p, q = F.get("h", F.lit(0)), F.get("h", F.lit(1))
    return rows.select("row", "col", "level", contour_class(F.col("level"), index_interval).alias("kind"), p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


#: Cells a side of the blocks whose pieces one task strings together.
BLOCK = 256
_CHAINS = "level double, s long, e long, least long, crosses boolean, pts array<struct<x:double,y:double>>"


def _ways(after: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each piece, whose follower is after (-1 for none): the last piece of its way, the pieces on it after this one, the least s from here on, and whether the way ends.

    Pointers double their length each round. On a ring all know the least s when nothing changes.
    """
    ended, at = after < 0, np.where(after < 0, np.arange(len(after)), after)
    hops, least = (~ended).astype(np.int64), s
    least = np.minimum(least, least[at])
    while True:
        # one step beyond what at has: the piece at `at` counts from its own way
        now_ended, now_least = ended | ended[at], np.minimum(least, least[at])
        if (now_ended == ended).all() and (now_least == least).all():
            return at, hops, least, ended
        hops = np.where(ended, hops, hops + hops[at])
        at, ended, least = np.where(ended, at, at[at]), now_ended, now_least


def _strung(level: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a block in order, chain after chain, and where chains begin: each as long as pieces follow one another here.

    A ring begins with its least edge.
    """
    steps, edges = np.unique(level, return_inverse=True)[1], np.unique(np.concatenate([s, e]), return_inverse=True)[1]
    starts, ends = steps * len(s) * 2 + edges[: len(s)], steps * len(s) * 2 + edges[len(s) :]
    order = np.argsort(starts)
    found = np.minimum(np.searchsorted(starts[order], ends), len(s) - 1)
    after = np.where(starts[order][found] == ends, order[found], -1)
    last, hops, least, ended = _ways(after, s)
    if not ended.all():
        closing = ~ended & (e == least)
        last, hops, _, _ = _ways(np.where(closing, -1, after), s)
    order = np.lexsort((-hops, last))
    return order, np.flatnonzero(np.diff(last[order], prepend=-1))


def _chains(interval: float, side: int):
    """The chains of one block from its cells (place, h) and the first row and column of its neighbours'."""
    wide = side + 1
    schema = pa.schema([("level", pa.float64()), ("s", pa.int64()), ("e", pa.int64()), ("least", pa.int64()), ("crosses", pa.bool_()), ("pts", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        place, h = cells.column("place").to_numpy(), cells.column("h").to_numpy()
        height, there = np.full(wide * wide, -np.inf), np.zeros((wide, wide), bool)
        np.maximum.at(height, place, h)
        there.ravel()[place] = True
        r, c = np.nonzero(there[:-1, :-1] & there[:-1, 1:] & there[1:, :-1] & there[1:, 1:])
        height = height.reshape(wide, wide)
        corner = [(c + dc + key[1].as_py() * side, r + dr + key[0].as_py() * side, height[r + dr, c + dc]) for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1))]
        # vertices of both triangles of each cell
        x, y, z = (np.concatenate([np.stack([corner[v][k] for v in t], 1) for t in ((0, 1, 2), (3, 2, 1))]) for k in range(3))
        first, end = np.ceil(z.min(1) / interval).astype(np.int64), np.floor(z.max(1) / interval).astype(np.int64) + 1
        n = np.maximum(end - first, 0)
        own = np.repeat(np.arange(len(n)), n)
        level = (first[own] + np.arange(len(own)) - (np.cumsum(n) - n)[own]) * float(interval)
        above = z[own] >= level[:, None]
        falls, rises = above & ~np.roll(above, -1, 1), ~above & np.roll(above, -1, 1)
        met = falls.any(1)
        own, level, falls, rises = own[met], level[met], falls[met].argmax(1), rises[met].argmax(1)
        if not len(own):
            return schema.empty_table()

        def crossing(a: np.ndarray) -> tuple[np.ndarray, ...]:
            """The number of the edge from vertex a, the same from both its triangles; whether it is on a seam; where the level lies on it. Rows and columns from 0 to 2**29."""
            b = (a + 1) % 3
            (ax, bx), (ay, by), (az, bz) = ((v[own, a], v[own, b]) for v in (x, y, z))
            k = (np.minimum(ay, by) * (1 << 31) + np.minimum(ax, bx)) * 4 + np.where(ay == by, 0, np.where(ax == bx, 1, 2))
            part = (level - az) / (bz - az)
            return k, (ay == by) & (ay % side == 0) | (ax == bx) & (ax % side == 0), ax + (bx - ax) * part, ay + (by - ay) * part

        s, s_seam, x1, y1 = crossing(falls)
        e, e_seam, x2, y2 = crossing(rises)
        order, begin = _strung(level, s, e)
        stop = np.append(begin[1:], len(order))
        head, tail = order[begin], order[stop - 1]
        # a chain has one point more than it has pieces
        pts = pa.StructArray.from_arrays([pa.array(np.insert(a[order], stop, b[tail])) for a, b in ((x1, x2), (y1, y2))], names=["x", "y"])
        offsets = pa.array(np.append(begin + np.arange(len(begin)), len(order) + len(begin)).astype(np.int32))
        crosses = (s[head] != e[tail]) & (s_seam[head] | e_seam[tail])
        columns = [level[head], s[head], e[tail], np.minimum.reduceat(s[order], begin), crosses]
        return pa.Table.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(offsets, pts)], schema=schema)

    return run


def _dealt(dem: DataFrame, side: int) -> DataFrame:
    """(block_row, block_col, place, h): cells with those of the row and column after each block, places in side + 1 columns."""
    rows = dem.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("elev").cast("double").alias("h")).dropna()
    inside = {k: F.pmod(k, F.lit(side)) for k in ("row", "col")}
    blocks = F.array(*[F.when(on, F.struct((F.floor(F.col("row") / side) - up).alias("block_row"), (F.floor(F.col("col") / side) - left).alias("block_col"))) for up, left, on in ((0, 0, F.lit(True)), (1, 0, inside["row"] == 0), (0, 1, inside["col"] == 0), (1, 1, (inside["row"] == 0) & (inside["col"] == 0)))])
    rows = rows.withColumn("b", F.explode(F.filter(blocks, lambda b: b.isNotNull()))).select("b.*", "row", "col", "h")
    place = (F.col("row") - F.col("block_row") * side) * (side + 1) + F.col("col") - F.col("block_col") * side
    return rows.select("block_row", "block_col", place.cast("int").alias("place"), "h")


def _jumped(links: DataFrame) -> DataFrame:
    """(level, s, e, least, hops) of links from s to e: e the end of the way that starts with each link, least the least on it, hops the links on it.

    Pointers double their length each round, each round a written table. On a ring there is no
    end; rounds stop when ends and leasts no longer change, which on a ring means that all know its least.
    """
    state = kept(links.select("level", "s", "e", "least", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("ended")))
    while True:
        ahead = state.select("level", F.col("s").alias("e"), F.col("e").alias("_e"), F.col("least").alias("_least"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"))
        moved = state.filter("NOT ended").join(ahead, ["level", "e"], "left")
        ended = F.col("_e").isNull() | F.col("_ended")
        least = F.least("least", "_least")
        moved = moved.select("level", "s", F.coalesce("_e", "e").alias("e"), least.alias("least"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), ended.alias("ended"), (ended | (least < F.col("least"))).alias("_new"))
        whole = kept(state.filter("ended").withColumn("_new", F.lit(False)).unionByName(moved))
        state = whole.drop("_new")
        if whole.filter("_new").isEmpty():
            return state


def contour_polylines(dem: DataFrame, interval: float = 10.0, index_interval: float = 50.0) -> DataFrame:
    """(line, level, kind, closed, pts): contour lines as ordered points, higher ground on one side all along, a closed contour in one row.

    Pieces go from the edge where their triangle falls below the level to the one where it rises
    again, so pieces of neighbours follow one another by the edge they share. Blocks of cells
    string their own pieces as arrays, with one shuffle of the cells; only chains with an end on a
    seam of blocks are put in order by pointer jumping. line is the last edge of an open line, the
    least of a closed one. Null heights and those that are no numbers have no cells; an empty grid
    gives no lines.
    """
    chains = kept(_dealt(dem, BLOCK).groupBy("block_row", "block_col").applyInArrow(_chains(interval, BLOCK), _CHAINS))
    crossing = chains.filter("crosses")
    links = crossing.select("level", "s", "e", "least")
    found = _jumped(links).withColumn("line", F.when(F.col("ended"), F.col("e")).otherwise(F.col("least"))).select("level", "s", "line", (~F.col("ended")).alias("closed"))
    # a ring begins with the chain that has its least edge and ends before it
    named = kept(links.join(found, ["level", "s"]))
    begins = named.filter("closed AND least = line").select("level", F.col("s").alias("e"), F.lit(True).alias("_cut"))
    cut = named.join(begins, ["level", "e"], "left").withColumn("e", F.when(F.col("_cut"), -1 - F.col("e")).otherwise(F.col("e")))
    order = _jumped(cut).select("level", "s", "hops").join(named.select("level", "s", "line", "closed"), ["level", "s"])
    parts = crossing.select("level", "s", "pts").join(order, ["level", "s"])
    stacked = F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("o"), "pts")), lambda a, b: F.when(a["o"] < b["o"], -1).otherwise(F.when(a["o"] > b["o"], 1).otherwise(0)))
    joined = parts.groupBy("level", "line", "closed").agg(stacked.alias("_p"))
    pts = F.flatten(F.transform("_p", lambda p, i: F.when(i == 0, p["pts"]).otherwise(F.slice(p["pts"], F.lit(2), F.size(p["pts"])))))
    ring = F.col("s") == F.col("e")
    own = chains.filter("NOT crosses").select("level", F.when(ring, F.col("least")).otherwise(F.col("e")).alias("line"), ring.alias("closed"), "pts")
    every = joined.select("level", "line", "closed", pts.alias("pts")).unionByName(own)
    return every.select("line", "level", contour_class(F.col("level"), index_interval).alias("kind"), "closed", "pts")
