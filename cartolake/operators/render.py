"""From a style and features to pixels: layers are resolved, geometries brought to the screen, and shapes blended in paint order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.values import byte, color
from cartolake.operators import geometry, raster, runs
from cartolake.plans.style import DEFAULTS, Style, StyleError, apply_style


def _paths(rows: DataFrame) -> DataFrame:
    """One row for each path of each geometry, with its points on the screen."""
    return rows.select("*", F.explode("_paths").alias("_path")).withColumn("pts", F.col("_path.pts")).drop("_path")


def _bevels(lines: DataFrame) -> DataFrame:
    """Triangles on the outer side of each inner vertex, as polygons."""
    n = F.size("pts")

    def side(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = F.sqrt(dx * dx + dy * dy)
        safe = F.when(size > 0, size).otherwise(1.0)
        return F.struct((-dy / safe).alias("x"), (dx / safe).alias("y"))

    def triangle(i: Column) -> Column:
        a, p, b = F.get("pts", i - 1), F.get("pts", i), F.get("pts", i + 1)
        turn = (p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])
        half = F.when(turn > 0, -F.col("line_width") / 2.0).otherwise(F.col("line_width") / 2.0)
        at = lambda m: F.struct((p["x"] + m["x"] * half).alias("x"), (p["y"] + m["y"] * half).alias("y"))
        return F.array(F.array(p, at(side(a, p)), at(side(p, b))))

    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return lines.select(*raster.KEYS, "rgba", F.explode(F.transform(inner, triangle)).alias("rings"))


def _line_pixels(lines: DataFrame, width: int, height: int, cap: str, join: str, dashes: list[float] | None) -> DataFrame:
    """Strokes with joins; each pixel of a line once. Miter joins are drawn round."""
    segs = raster.segments(lines, dashes).withColumn("cap", F.lit(cap))
    if dashes is None and join != "bevel":
        inner = segs.filter("seg > 0").withColumns({"x1": F.col("x0"), "y1": F.col("y0"), "cap": F.lit("round")})
        segs = segs.unionByName(inner)
    drawn = raster.strokes(segs, width, height)
    if dashes is not None or join != "bevel":
        return drawn
    every = drawn.unionByName(raster.fills(_bevels(lines), width, height).select(*raster.KEYS, "px", "py", "rgba"))
    return every.groupBy(*raster.KEYS, "px", "py").agg(F.first("rgba").alias("rgba"))


def render(features: DataFrame, style: Style, box: tuple[float, float, float, float], width: int, height: int, zoom: float | Column = 0.0, canvas_col: str | None = None) -> DataFrame:
    """(canvas, px, py, rgba) of features (fid, geom, properties) drawn by a style; pixels that nothing touches have no row.

    Points become discs of whole radii that take their pixels as they are, in the fill colour or
    red; lines strokes with width, opacity (alpha is cut), offset, dashes, caps and joins; polygons even-odd
    fills with an outline where the layer has a line colour. Parts of a multi geometry are drawn one by one. A canvas
    without extent and a style without layers are errors. canvas_col names a column that tells canvases apart, such
    as a tile; each is drawn by itself.
    """
    if not canvas_col:
        return _pixels(_styled(features, style, box, width, height, zoom, None), style, width, height)
    drawn = render_runs(features, style, box, width, height, zoom, canvas_col)
    return drawn.select("canvas", F.explode(F.sequence("a", "b")).alias("px"), "py", "rgba")


def render_runs(features: DataFrame, style: Style, box: tuple[float, float, float, float], width: int, height: int, zoom: float | Column, canvas_col: str) -> DataFrame:
    """(canvas, py, a, b, rgba): the pixels of render in runs a to b of one colour; runs that touch may have one colour.

    A canvas of few features is drawn by one task as runs; where many features lie on one, the canvas
    is high, or lines have dashes or bevel joins, pixels are spread over tasks.
    """
    styled = _styled(features, style, box, width, height, zoom, canvas_col)
    pixel_runs = lambda rows: _pixels(rows, style, width, height).select("canvas", "py", F.col("px").alias("a"), F.col("px").alias("b"), "rgba")
    if height > raster.BAND or any(layer.fixed.get("line-dasharray") or layer.fixed["line-join"] == "bevel" for layer in style.layers):
        return pixel_runs(styled)
    many = runs.crowded(styled.select("canvas"))
    if many is None:
        return runs.drawn(_shapes(styled, style), width, height)
    full = F.col("canvas").eqNullSafe(F.col("_canvas"))
    few = runs.drawn(_shapes(styled.join(many, full, "left_anti"), style), width, height)
    return few.unionByName(pixel_runs(styled.join(many, full, "left_semi")))


def _styled(features: DataFrame, style: Style, box: tuple[float, float, float, float], width: int, height: int, zoom: float | Column, canvas_col: str | None) -> DataFrame:
    """A row for each feature and layer that draws it, with its paths on the screen."""
    if width <= 0 or height <= 0:
        raise ValueError("a canvas needs a width and a height")
    if not style.layers:
        raise StyleError("a style needs a layer")
    canvas = F.col(canvas_col).cast("string") if canvas_col else F.lit("all")
    df = features.withColumns({"_canvas": canvas, "_paths": F.transform("geom.paths", lambda p: F.struct(p["part"].alias("part"), geometry.to_screen(p["pts"], box, width, height).alias("pts"))), "geometry_type": geometry.geometry_type(F.col("geom"))})
    return apply_style(df, style, zoom, keep=("fid", "_canvas", "_paths", "geometry_type")).withColumnRenamed("_canvas", "canvas")


def _disc_color() -> Column:
    return F.coalesce("fill_color", color(*DEFAULTS["pixels"]["point-color"]))


def _line_color() -> Column:
    return color(F.col("line_color.r"), F.col("line_color.g"), F.col("line_color.b"), byte(F.col("line_color.a") * F.col("line_opacity")))


def _shapes(styled: DataFrame, style: Style) -> DataFrame:
    """What runs.drawn takes: a row for the points, the fill and the lines of each styled feature."""
    every = []

    def add(rows: DataFrame, role: int, rgba: Column, size: Column, cap: int = 0) -> None:
        every.append(rows.select(*raster.KEYS, rgba.alias("rgba"), F.lit(role == runs.DISC).alias("solid"), F.lit(role).alias("role"), size.cast("double").alias("size"), F.lit(cap).alias("cap"), F.col("_paths").alias("paths")))

    add(styled.filter("geometry_type = 'Point'"), runs.DISC, _disc_color(), F.col("circle_radius"))
    add(styled.filter("geometry_type = 'Polygon' AND fill_color IS NOT NULL"), runs.FILL, F.col("fill_color"), F.lit(0.0))
    for order, layer in enumerate(style.layers):
        lines = styled.filter((F.col("layer_ord") == order) & _has_lines(layer))
        if layer.properties.get("line-offset") is not None:
            lines = lines.withColumn("_paths", F.transform("_paths", lambda p: F.struct(p["part"].alias("part"), F.when(F.col("line_offset") != 0, geometry.offset_line(p["pts"], F.col("line_offset"))).otherwise(p["pts"]).alias("pts"))))
        add(lines, runs.STROKE, _line_color(), F.greatest("line_width", F.lit(1.0)), runs.CAPS.index(layer.fixed["line-cap"]))
    return reduce(DataFrame.unionByName, every)


def _has_lines(layer) -> Column:
    drawn = F.col("geometry_type") == "LineString"
    return drawn | (F.col("geometry_type") == "Polygon") if layer.properties.get("line-color") is not None else drawn


def _pixels(styled: DataFrame, style: Style, width: int, height: int) -> DataFrame:
    pixels = []
    points = _paths(styled.filter("geometry_type = 'Point'").withColumn("rgba", _disc_color()))
    points = points.select(*raster.KEYS, F.explode("pts").alias("p"), F.col("circle_radius").alias("radius"), "rgba").select(*raster.KEYS, "p.x", "p.y", "radius", "rgba")
    pixels.append(raster.discs(points, width, height).withColumn("solid", F.lit(True)))
    polygons = styled.filter("geometry_type = 'Polygon' AND fill_color IS NOT NULL").select(*raster.KEYS, "_paths", F.col("fill_color").alias("rgba"), F.explode(F.array_distinct(F.col("_paths.part"))).alias("_part"))
    rings = polygons.select(*raster.KEYS, "rgba", F.transform(F.filter("_paths", lambda p: p["part"] == F.col("_part")), lambda p: p["pts"]).alias("rings"))
    pixels.append(raster.fills(rings, width, height).withColumn("solid", F.lit(False)))
    for order, layer in enumerate(style.layers):
        lines = _paths(styled.filter((F.col("layer_ord") == order) & _has_lines(layer))).withColumn("rgba", _line_color())
        if layer.properties.get("line-offset") is not None:
            lines = lines.withColumn("pts", F.when(F.col("line_offset") != 0, geometry.offset_line(F.col("pts"), F.col("line_offset"))).otherwise(F.col("pts")))
        lines = lines.select(*raster.KEYS, "pts", "line_width", "rgba").withColumn("line_width", F.greatest("line_width", F.lit(1.0)))
        dashes = layer.fixed.get("line-dasharray")
        strokes = _line_pixels(lines, width, height, layer.fixed["line-cap"], layer.fixed["line-join"], [float(d) for d in dashes] if dashes else None)
        pixels.append(strokes.withColumn("solid", F.lit(False)))
    return raster.blend(reduce(DataFrame.unionByName, pixels))
