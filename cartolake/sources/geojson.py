"""GeoJSON files as feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.operators.geometry import GEOMETRY, POINTS
from cartolake.sources.pieces import PIECE, feature_texts

_FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:variant>,properties:variant>"


def read_geojson(spark: SparkSession, path: str, points_only: bool = False, strict: bool = False) -> DataFrame:
    """(fid, geometry_type, geom, props) from feature collections, one document a file.

    props is a VARIANT. Features without geometry or with broken coordinates are left out, or
    fail the read if strict. points_only keeps points and drops the others silently.
    """
    schema = f"type string, features array<{_FEATURE}>"
    docs = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST" if strict else "PERMISSIVE")
    return features_of(docs.withColumn("_file", F.col("_metadata.file_path")), points_only, strict)


def features_of(docs: DataFrame, points_only: bool = False, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for rows with an array `features`, with the columns of keep; fid numbers the features of a document."""
    return _shaped(docs.select(*keep, F.posexplode("features").alias("fid", "f")), points_only, strict, keep)


def read_pieces(spark: SparkSession, path: str, points_only: bool = False, strict: bool = False, piece: int = PIECE) -> DataFrame:
    """(path, fid, geometry_type, geom, props) as read_geojson has them, with each file read in pieces by many tasks.

    Files may have any size. fid numbers the objects in a file's list of features.
    """
    texts = feature_texts(spark, path, piece)
    f = F.from_json("text", _FEATURE, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return _shaped(texts.select("path", "fid", F.explode(F.array(f)).alias("f")), points_only, strict, ("path",))


def _shaped(rows: DataFrame, points_only: bool, strict: bool, keep: tuple[str, ...]) -> DataFrame:
    """Features (fid, f) with the columns of keep as rows with geometry.

    A text and its geometry are made once, by explode, which the filter on them stays above: below
    it, both would be made again for each use.
    """
    c = F.col("f.geometry.coordinates")
    as_points = lambda a: F.transform(a, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).cast(POINTS)
    cast = lambda depth: F.try_variant_get(c, "$", "array<" * depth + "double" + ">" * depth)
    path = lambda part, hole, p: F.struct(part.cast("int").alias("part"), hole.alias("hole"), p.alias("pts"))
    no = F.lit(False)
    one = F.array(cast(1))
    forms = {
        "Point": F.array(path(F.lit(0), no, as_points(one))),
        "LineString": F.array(path(F.lit(0), no, as_points(cast(2)))),
        "Polygon": F.transform(cast(3), lambda r, i: path(F.lit(0), i > 0, as_points(r))),
        "MultiPoint": F.transform(cast(2), lambda p, i: path(i, no, as_points(F.array(p)))),
        "MultiLineString": F.transform(cast(3), lambda r, i: path(i, no, as_points(r))),
        "MultiPolygon": F.flatten(F.transform(cast(4), lambda g, i: F.transform(g, lambda r, j: path(i, j > 0, as_points(r))))),
    }
    kind = F.col("f.geometry.type")
    geom = None
    for name, paths in forms.items():
        if points_only and name != "Point":
            continue
        value = F.struct(F.lit(name).alias("kind"), paths.alias("paths")).cast(GEOMETRY)
        geom = F.when(kind == name, value) if geom is None else geom.when(kind == name, value)
    shaped = F.struct(F.regexp_replace(kind, "^Multi", "").alias("geometry_type"), geom.alias("geom"), F.col("f.properties").alias("props"))
    out = rows.select(*keep, "fid", F.explode(F.array(shaped)).alias("_s")).select(*keep, "fid", "_s.*")
    good = F.col("geom").isNotNull() & F.coalesce(F.size("geom.paths") > 0, F.lit(False)) & ~F.exists(F.flatten(F.transform("geom.paths", lambda p: p["pts"])), lambda p: p["x"].isNull() | p["y"].isNull())
    if strict:
        return out.withColumn("geom", F.when(good | F.lit(points_only) & (F.col("geometry_type") != "Point"), F.col("geom")).otherwise(F.raise_error(F.lit("a feature without usable geometry")).cast(GEOMETRY))).filter(F.col("geom").isNotNull())
    return out.filter(F.coalesce(good, F.lit(False)))


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """min_x,min_y,max_x,max_y: exactly four numbers."""
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers")
    return tuple(parts)  # type: ignore[return-value]


def auto_bbox(points: DataFrame, x: str = "x", y: str = "y") -> tuple[float, float, float, float] | None:
    """The box of all points, 1.0 wider on both sides where it has no extent; None for no points."""
    r = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    if r[0] is None:
        return None
    x0, y0, x1, y1 = r
    if x1 - x0 < 1e-10:
        x0, x1 = x0 - 1.0, x1 + 1.0
    if y1 - y0 < 1e-10:
        y0, y1 = y0 - 1.0, y1 + 1.0
    return x0, y0, x1, y1
