"""Geometry as nested columns: measures, envelopes, transforms, WKT and WKB.

A geometry is a struct of its kind and its paths; a path has the number of its part, whether it
is a hole, and its points. Higher-order functions keep the measures in the JVM.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.functions.values import number_text

POINT = "struct<x:double,y:double>"
POINTS = f"array<{POINT}>"
GEOMETRY = f"struct<kind:string,paths:array<struct<part:int,hole:boolean,pts:{POINTS}>>>"
_POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_PATH_TYPE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("hole", T.BooleanType()), T.StructField("pts", T.ArrayType(_POINT_TYPE))])
GEOMETRY_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("paths", T.ArrayType(_PATH_TYPE))])
_ARROW_GEOMETRY = pa.struct([("kind", pa.string()), ("paths", pa.list_(pa.struct([("part", pa.int32()), ("hole", pa.bool_()), ("pts", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])))])
KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str, *rings: Column) -> Column:
    """One part of the kind: its points, or exterior and holes."""
    paths = [F.struct(F.lit(0).alias("part"), F.lit(i > 0).alias("hole"), r.alias("pts")) for i, r in enumerate(rings)]
    return F.struct(F.lit(kind).alias("kind"), F.array(*paths).alias("paths")).cast(GEOMETRY)


def geometry_type(geom: Column) -> Column:
    """The kind without Multi."""
    return F.regexp_replace(geom["kind"], "^Multi", "")


def vertices(geom: Column) -> Column:
    return F.flatten(F.transform(geom["paths"], lambda p: p["pts"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _turned(pts: Column) -> Column:
    return F.concat(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))


def _ring(pts: Column) -> Column:
    """One fold over a path: cross (shoelace sum), cx, cy (weighted sums), len (without the closing edge), x, y (the last point)."""
    at = lambda k: F.coalesce(F.get(pts, F.lit(0))[k], F.lit(0.0)).alias(k)
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("cross", "cx", "cy", "len")], at("x"), at("y"))

    def step(s: Column, p: Column) -> Column:
        c = s["x"] * p["y"] - p["x"] * s["y"]
        size = F.sqrt((p["x"] - s["x"]) * (p["x"] - s["x"]) + (p["y"] - s["y"]) * (p["y"] - s["y"]))
        return F.struct((s["cross"] + c).alias("cross"), (s["cx"] + (s["x"] + p["x"]) * c).alias("cx"), (s["cy"] + (s["y"] + p["y"]) * c).alias("cy"), (s["len"] + size).alias("len"), p["x"].alias("x"), p["y"].alias("y"))

    def closed(s: Column) -> Column:
        x, y = F.get(pts, F.lit(0))["x"], F.get(pts, F.lit(0))["y"]
        c = s["x"] * y - x * s["y"]
        ring = F.size(pts) >= 3
        close = lambda v: F.when(ring, v).otherwise(0.0)
        return F.struct(close((s["cross"] + c) / 2.0).alias("area"), close(s["cx"] + (s["x"] + x) * c).alias("cx"), close(s["cy"] + (s["y"] + y) * c).alias("cy"), s["len"].alias("len"))

    return F.aggregate(pts, zero, step, closed)


def rings(geom: Column) -> Column:
    """For each path: hole, and area (signed), cx, cy (weighted sums), len of one fold. area, length and centroid take it in place of a geometry's paths."""
    return F.transform(geom["paths"], lambda p: F.struct(p["hole"].alias("hole"), _ring(p["pts"]).alias("m")))


def signed_area(pts: Column) -> Column:
    """Half the shoelace sum of a ring, closed by itself; 0 for fewer than three points."""
    return _ring(pts)["area"]


def path_length(pts: Column) -> Column:
    return _ring(pts)["len"]


def area(geom: Column, folded: Column | None = None) -> Column:
    """Exteriors less holes, of all parts; 0 for points and lines. folded: rings(geom), if it is a column already."""
    parts = F.transform(rings(geom) if folded is None else folded, lambda r: F.when(r["hole"], -F.abs(r["m"]["area"])).otherwise(F.abs(r["m"]["area"])))
    return F.when(geometry_type(geom) == "Polygon", _sum(parts)).otherwise(0.0)


def length(geom: Column, compat: bool = False, folded: Column | None = None) -> Column:
    """Length of lines, and of rings with holes as they are. compat leaves MultiPolygon at 0."""
    lines = ["LineString", "Polygon", "MultiLineString"] + ([] if compat else ["MultiPolygon"])
    return F.when(geom["kind"].isin(lines), _sum(F.transform(rings(geom) if folded is None else folded, lambda r: r["m"]["len"]))).otherwise(0.0)


def _mean(pts: Column) -> Column:
    n = F.size(pts).cast("double")
    at = lambda k: F.when(n > 0, _sum(F.transform(pts, lambda p: p[k])) / n).otherwise(float("nan"))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def _centre(m: Column, k: str) -> Column:
    flat = F.abs(m["area"]) < 1e-10
    return F.when(flat, 0.0).otherwise(m["c" + k] / (F.when(flat, 1.0).otherwise(m["area"]) * 6.0))


def centroid(geom: Column, compat: bool = False, folded: Column | None = None) -> Column:
    """Mean of the vertices of points and lines; area centre of a polygon's exterior (0, 0 if it has no area).

    Multi polygons take the area-weighted mean of their parts; compat gives (0, 0) for multi lines
    and multi polygons.
    """
    exteriors = F.filter(rings(geom) if folded is None else folded, lambda r: ~r["hole"])
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, r: Column) -> Column:
        w = F.abs(r["m"]["area"])
        return F.struct((s["w"] + w).alias("w"), (s["x"] + w * _centre(r["m"], "x")).alias("x"), (s["y"] + w * _centre(r["m"], "y")).alias("y"))

    def mean(s: Column) -> Column:
        at = lambda k: F.when(s["w"] > 0, s[k] / F.when(s["w"] > 0, s["w"]).otherwise(1.0)).otherwise(0.0)
        return F.struct(at("x").alias("x"), at("y").alias("y"))

    first = F.transform(F.slice(exteriors, 1, 1), lambda r: F.struct(_centre(r["m"], "x").alias("x"), _centre(r["m"], "y").alias("y")))
    nowhere = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    out = F.when(geom["kind"] == "Polygon", F.coalesce(F.get(first, F.lit(0)), nowhere))
    if compat:
        out = out.when(geom["kind"].isin("MultiPolygon", "MultiLineString"), nowhere)
    return out.when(geom["kind"] == "MultiPolygon", F.aggregate(exteriors, zero, add, mean)).otherwise(_mean(vertices(geom)))


def measures(df: DataFrame, geom: str) -> DataFrame:
    """Adds area, length and centroid of a geometry column, with one fold over each path."""
    rows = df.withColumn("_rings", rings(F.col(geom)))
    folded, g = F.col("_rings"), F.col(geom)
    return rows.withColumns({"area": area(g, folded), "length": length(g, folded=folded), "centroid": centroid(g, folded=folded)}).drop("_rings")


def envelope(geom: Column) -> Column:
    """min_x, min_y, max_x, max_y over all vertices; for none the largest and smallest doubles, swapped."""
    top = 1.7976931348623157e308
    none = F.struct(F.lit(top).alias("min_x"), F.lit(top).alias("min_y"), F.lit(-top).alias("max_x"), F.lit(-top).alias("max_y"))

    def wider(s: Column, p: Column) -> Column:
        return F.struct(F.least(s["min_x"], p["x"]).alias("min_x"), F.least(s["min_y"], p["y"]).alias("min_y"), F.greatest(s["max_x"], p["x"]).alias("max_x"), F.greatest(s["max_y"], p["y"]).alias("max_y"))

    return F.aggregate(geom["paths"], none, lambda s, path: F.aggregate(path["pts"], s, wider))


def to_screen(pts: Column, box: tuple[float, float, float, float], width: int, height: int) -> Column:
    """Map to screen coordinates, y down. A box without extent maps to 0."""
    x0, y0, x1, y1 = box
    sx, sy = (width / (x1 - x0) if x1 != x0 else 0.0), (height / (y1 - y0) if y1 != y0 else 0.0)
    return F.transform(pts, lambda p: F.struct(((p["x"] - x0) * sx).alias("x"), ((F.lit(y1) - p["y"]) * sy).alias("y")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: is the point inside the ring."""

    def crosses(a: Column, b: Column) -> Column:
        rise = b["y"] - a["y"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(rise == 0, 1.0).otherwise(rise) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.aggregate(F.zip_with(ring, _turned(ring), crosses), F.lit(False), lambda s, c: s != c)


def offset_line(pts: Column, distance: Column | float) -> Column:
    """Each vertex moved along its normal: ends by their edge's, others by the renormalised mean of both."""
    n = F.size(pts)

    def normal(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = F.sqrt(dx * dx + dy * dy)
        safe = F.when(size > 0, size).otherwise(1.0)
        return F.struct((-dy / safe).alias("x"), (dx / safe).alias("y"))

    def moved(p: Column, i: Column) -> Column:
        before = normal(F.coalesce(F.get(pts, i - 1), p), p)
        after = normal(p, F.coalesce(F.get(pts, i + 1), p))
        x = F.when(i == 0, after["x"]).when(i == n - 1, before["x"]).otherwise(before["x"] + after["x"])
        y = F.when(i == 0, after["y"]).when(i == n - 1, before["y"]).otherwise(before["y"] + after["y"])
        size = F.sqrt(x * x + y * y)
        safe = F.when(size > 1e-12, size).otherwise(1.0)
        return F.struct((p["x"] + x / safe * distance).alias("x"), (p["y"] + y / safe * distance).alias("y"))

    return F.transform(pts, moved)


def at_distance(pts: Column, distance: Column) -> Column:
    """The point a distance along a line, and the angle there: (x, y, angle); null beyond its ends."""
    n = F.size(pts)
    zero = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("struct<x:double,y:double,angle:double>").alias("hit"))

    def step(s: Column, i: Column) -> Column:
        a, b = F.get(pts, i - 1), F.get(pts, i)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = F.sqrt(dx * dx + dy * dy)
        t = (distance - s["done"]) / F.when(size > 0, size).otherwise(1.0)
        here = F.struct((a["x"] + dx * t).alias("x"), (a["y"] + dy * t).alias("y"), F.atan2(dy, dx).alias("angle"))
        inside = s["hit"].isNull() & (distance >= s["done"]) & (distance <= s["done"] + size) & (size > 0)
        return F.struct((s["done"] + size).alias("done"), F.when(inside, here).otherwise(s["hit"]).alias("hit"))

    indexes = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indexes, zero, step, lambda s: s["hit"])


def to_wkt(geom: Column) -> Column:
    """WKT with plain decimals."""
    one = lambda p: F.concat(number_text(p["x"]), F.lit(" "), number_text(p["y"]))
    ring = lambda pts: F.concat(F.lit("("), F.array_join(F.transform(pts, one), ", "), F.lit(")"))
    rings = lambda paths: F.array_join(F.transform(paths, lambda p: ring(p["pts"])), ", ")
    paths = geom["paths"]
    parts = F.array_distinct(F.transform(paths, lambda p: p["part"]))
    polygons = F.array_join(F.transform(parts, lambda i: F.concat(F.lit("("), rings(F.filter(paths, lambda p: p["part"] == i)), F.lit(")"))), ", ")
    wrap = lambda name, body: F.concat(F.lit(name + " ("), body, F.lit(")"))
    kind = geom["kind"]
    return (
        F.when(kind == "Point", wrap("POINT", one(F.get(vertices(geom), F.lit(0)))))
        .when(kind == "LineString", F.concat(F.lit("LINESTRING "), rings(paths)))
        .when(kind == "Polygon", wrap("POLYGON", rings(paths)))
        .when(kind == "MultiPoint", wrap("MULTIPOINT", F.array_join(F.transform(vertices(geom), lambda p: F.concat(F.lit("("), one(p), F.lit(")"))), ", ")))
        .when(kind == "MultiLineString", wrap("MULTILINESTRING", rings(paths)))
        .when(kind == "MultiPolygon", wrap("MULTIPOLYGON", polygons))
    )


def from_wkt(wkt: Column) -> Column:
    """A geometry from WKT by splitting at its parentheses; null for EMPTY, Z, M, collections and anything malformed."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    pair = rf"{number}\s+{number}"
    pairs = rf"{pair}(?:\s*,\s*{pair})*+"
    ring = rf"\(\s*{pairs}\s*\)"
    rings = rf"{ring}(?:\s*,\s*{ring})*+"
    forms = {
        "Point": rf"POINT\s*\(\s*{pair}\s*\)",
        "LineString": rf"LINESTRING\s*{ring}",
        "Polygon": rf"POLYGON\s*\(\s*{rings}\s*\)",
        "MultiPoint": rf"MULTIPOINT\s*\(\s*(?:{rings}|{pairs})\s*\)",
        "MultiLineString": rf"MULTILINESTRING\s*\(\s*{rings}\s*\)",
        "MultiPolygon": rf"MULTIPOLYGON\s*\(\s*\(\s*{rings}\s*\)(?:\s*,\s*\(\s*{rings}\s*\))*+\s*\)",
    }
    s = F.btrim(wkt)
    split = lambda t: F.transform(F.regexp_extract_all(t, F.lit(pair), F.lit(0)), lambda p: F.split(p, r"\s+"))
    numbers = lambda t: F.transform(split(t), lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    all_rings = lambda t: F.regexp_extract_all(t, F.lit(ring), F.lit(0))
    path = lambda part, hole, pts: F.struct(part.cast("int").alias("part"), hole.alias("hole"), pts.alias("pts"))
    no = F.lit(False)
    single = F.array(path(F.lit(0), no, numbers(s)))
    polygon = F.transform(all_rings(s), lambda r, i: path(F.lit(0), i > 0, numbers(r)))
    each_point = F.transform(numbers(s), lambda p, i: path(i, no, F.array(p)))
    each_line = F.transform(all_rings(s), lambda r, i: path(i, no, numbers(r)))
    polygons = F.regexp_extract_all(F.regexp_replace(s, r"^MULTIPOLYGON\s*\(", ""), F.lit(rf"\(\s*{rings}\s*\)"), F.lit(0))
    each_polygon = F.flatten(F.transform(polygons, lambda g, i: F.transform(all_rings(g), lambda r, j: path(i, j > 0, numbers(r)))))
    bodies = {"Point": single, "LineString": single, "Polygon": polygon, "MultiPoint": each_point, "MultiLineString": each_line, "MultiPolygon": each_polygon}
    out = None
    for kind, form in forms.items():
        value = F.struct(F.lit(kind).alias("kind"), bodies[kind].alias("paths")).cast(GEOMETRY)
        out = F.when(s.rlike(rf"\A{form}\z"), value) if out is None else out.when(s.rlike(rf"\A{form}\z"), value)
    return out


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise ValueError("truncated")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def points(self, order: str) -> list[dict]:
        n = self.read(order + "I")[0]
        if n * 16 > len(self.data) - self.at:
            raise ValueError("truncated")
        v = self.read(f"{order}{2 * n}d")
        return [{"x": x, "y": y} for x, y in zip(v[::2], v[1::2], strict=True)]

    def geometry(self, part: int = 0) -> tuple[str, list[dict]]:
        order = "<" if self.read("B")[0] == 1 else ">"
        code = self.read(order + "I")[0]
        if not 1 <= code <= 6:
            raise ValueError("unsupported type")
        kind = KINDS[code - 1]
        if kind == "Point":
            x, y = self.read(order + "2d")
            return kind, [{"part": part, "hole": False, "pts": [{"x": x, "y": y}]}]
        if kind == "LineString":
            return kind, [{"part": part, "hole": False, "pts": self.points(order)}]
        n = self.read(order + "I")[0]
        if kind == "Polygon":
            if not n:
                raise ValueError("empty polygon")
            return kind, [{"part": part, "hole": i > 0, "pts": self.points(order)} for i in range(n)]
        return kind, [p for i in range(n) for p in self.geometry(i)[1]]


@F.arrow_udf(GEOMETRY_TYPE)
def from_wkb(data: pa.Array) -> pa.Array:
    """Geometries from WKB of types 1 to 6, either byte order; null where bytes are missing or the type is another."""
    out = []
    for x in data.to_pylist():
        try:
            kind, paths = _Reader(bytes(x)).geometry()
            out.append({"kind": kind, "paths": paths})
        except (ValueError, TypeError):
            out.append({"kind": None, "paths": None})
    return pa.array(out, _ARROW_GEOMETRY)


def _wkb(kind: str, paths: list) -> bytes:
    pts = lambda p: struct.pack("<I", len(p)) + b"".join(struct.pack("<2d", q["x"], q["y"]) for q in p)
    head = struct.pack("<BI", 1, KINDS.index(kind) + 1)
    if kind == "Point":
        p = paths[0]["pts"][0]
        return head + struct.pack("<2d", p["x"], p["y"])
    if kind == "LineString":
        return head + pts(paths[0]["pts"])
    if kind == "Polygon":
        return head + struct.pack("<I", len(paths)) + b"".join(pts(p["pts"]) for p in paths)
    parts: dict[int, list] = {}
    for p in paths:
        parts.setdefault(p["part"], []).append(p)
    return head + struct.pack("<I", len(parts)) + b"".join(_wkb(kind[5:], p) for p in parts.values())


@F.arrow_udf(T.BinaryType())
def to_wkb(geom: pa.Array) -> pa.Array:
    """Little-endian WKB; null where the geometry is."""
    return pa.array([None if g is None or g["kind"] is None else _wkb(g["kind"], g["paths"]) for g in geom.to_pylist()], pa.binary())
