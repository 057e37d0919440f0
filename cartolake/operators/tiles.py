"""XYZ tiles of Web Mercator: addresses, bounds, covers, and features by tile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Zooms that features are looked up at together; more are refused.
MAX_ZOOMS = 32


def tile_x(lon: Column, n: Column | float) -> Column:
    """Column of tiles for n tiles across; below 0 it stays 0."""
    return F.greatest(F.lit(0).cast("long"), F.floor((lon + 180.0) / 360.0 * n))


def tile_y(lat: Column, n: Column | float) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / F.lit(math.pi)) / 2.0 * n))


def tiles_across(z: Column) -> Column:
    return F.pow(F.lit(2.0), z.cast("double"))


def tile_of(lon: Column, lat: Column, z: Column | int) -> Column:
    """struct<z, x, y> of a place, held to the tiles that exist."""
    z = z if isinstance(z, Column) else F.lit(z)
    n = tiles_across(z)
    last = (n - 1).cast("long")
    return F.struct(z.cast("int").alias("z"), F.least(tile_x(lon, n), last).alias("x"), F.least(tile_y(lat, n), last).alias("y"))


def _latitude(y: Column, n: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - y * 2.0 / n))))


def bounds(z: Column, x: Column, y: Column) -> Column:
    """struct<west, south, east, north>."""
    n = tiles_across(z)
    return F.struct((x / n * 360.0 - 180.0).alias("west"), _latitude(y + 1, n).alias("south"), ((x + 1) / n * 360.0 - 180.0).alias("east"), _latitude(y, n).alias("north"))


def center(b: Column) -> Column:
    return F.struct(((b["west"] + b["east"]) / 2.0).alias("lon"), ((b["south"] + b["north"]) / 2.0).alias("lat"))


def size(b: Column) -> Column:
    return F.struct((b["east"] - b["west"]).alias("width"), (b["north"] - b["south"]).alias("height"))


def parent(t: Column) -> Column:
    """The tile above; null at zoom 0."""
    return F.when(t["z"] > 0, F.struct((t["z"] - 1).alias("z"), F.shiftright(t["x"], 1).alias("x"), F.shiftright(t["y"], 1).alias("y")))


def children(t: Column) -> Column:
    """The four tiles below, row by row."""
    one = lambda dx, dy: F.struct((t["z"] + 1).alias("z"), (t["x"] * 2 + dx).alias("x"), (t["y"] * 2 + dy).alias("y"))
    return F.array(one(0, 0), one(1, 0), one(0, 1), one(1, 1))


def contains(b: Column, lon: Column, lat: Column) -> Column:
    return lon.between(b["west"], b["east"]) & lat.between(b["south"], b["north"])


def intersects(a: Column, b: Column) -> Column:
    return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])


def cover(boxes: DataFrame, z: int | Column, west: str = "west", south: str = "south", east: str = "east", north: str = "north") -> DataFrame:
    """boxes with z, x, y of every tile that each box covers: rows from the north, then columns."""
    zoom = z if isinstance(z, Column) else F.lit(z)
    n = tiles_across(zoom)
    last = (n - 1).cast("long")
    hold = lambda c: F.least(c, last)
    ys = F.sequence(hold(tile_y(F.col(north), n)), hold(tile_y(F.col(south), n)))
    xs = F.sequence(hold(tile_x(F.col(west), n)), hold(tile_x(F.col(east), n)))
    rows = boxes.withColumn("z", zoom.cast("int")).withColumn("y", F.explode(ys))
    return rows.withColumn("x", F.explode(xs)) if not isinstance(z, Column) else rows.withColumn("_x", xs).withColumn("x", F.explode("_x")).drop("_x")


def features_in_tiles(vertices: DataFrame, tiles: DataFrame, id_col: str = "fid", lon: str = "x", lat: str = "y", compat: bool = False) -> DataFrame:
    """(id, z, x, y) for features with a vertex in a tile of tiles (z, x, y): an equi-join on the address.

    compat counts a vertex on an edge to the tiles on both sides, as closed bounds do. Polygons
    that hold a tile without a vertex in it are not found. vertices: one row a vertex.
    """
    zooms = [r["z"] for r in tiles.select("z").distinct().limit(MAX_ZOOMS + 1).collect()]
    if len(zooms) > MAX_ZOOMS:
        raise ValueError(f"tiles of more than {MAX_ZOOMS} zooms")
    every = F.array(*[F.lit(z) for z in zooms]) if zooms else F.array().cast("array<int>")
    rows = vertices.select(id_col, F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), F.explode(every).alias("z"))
    n = tiles_across(F.col("z"))
    last = (n - 1).cast("long")
    x, y = F.least(tile_x(F.col("_lon"), n), last), F.least(tile_y(F.col("_lat"), n), last)
    if compat:
        on_x = (F.col("_lon") + 180.0) / 360.0 * n == x
        on_y = F.col("_lat") == _latitude(y.cast("double"), n)
        xs = F.when(on_x & (x > 0), F.array(x, x - 1)).otherwise(F.array(x))
        ys = F.when(on_y & (y > 0), F.array(y, y - 1)).otherwise(F.array(y))
        keyed = rows.select(id_col, "z", F.explode(xs).alias("x"), ys.alias("ys")).select(id_col, "z", "x", F.explode("ys").alias("y"))
    else:
        keyed = rows.select(id_col, "z", x.alias("x"), y.alias("y"))
    return keyed.distinct().join(tiles.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi").select(id_col, "z", "x", "y")


def rollup(points: DataFrame, zooms: range, lon: str = "x", lat: str = "y", weight: str | None = None) -> DataFrame:
    """(z, x, y, n, total) over all zooms: points are summed once at the deepest zoom, and the levels above come from those sums."""
    deepest = max(zooms)
    value = F.col(weight) if weight else F.lit(1.0)
    t = tile_of(F.col(lon), F.col(lat), deepest)
    base = points.select(t.alias("t"), value.alias("w")).groupBy("t.x", "t.y").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    levels = base.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    up = F.lit(deepest) - F.col("z")
    down = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), up)).cast("long")
    return levels.groupBy("z", down("x").alias("x"), down("y").alias("y")).agg(F.sum("n").alias("n"), F.sum("w").alias("total"))
