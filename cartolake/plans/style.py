"""Style documents as projections: every layer resolves its properties for every feature."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.expressions import Context, Function, compile_expression, literal
from cartolake.functions.values import COLOR, NUMBER, SQL_TYPES, STRING, Value, color

#: Enumerations of layout properties; the first is the default.
ENUMS = {
    "line-cap": ("butt", "round", "square"),
    "line-join": ("miter", "round", "bevel"),
    "icon-anchor": ("center", "left", "right", "top", "bottom", "top-left", "top-right", "bottom-left", "bottom-right"),
}
COLORS = ("fill-color", "line-color", "text-color")
NUMBERS = ("circle-radius", "line-width", "line-offset", "line-opacity", "icon-size", "icon-rotate", "text-size")
STRINGS = ("icon-image", "text-field")
#: What unresolved properties become, when drawn as pixels and when drawn as paths.
DEFAULTS = {
    "pixels": {"line-color": (0, 0, 0, 255), "line-width": 1.0, "line-offset": 0.0, "line-opacity": 1.0, "circle-radius": 4.0, "point-color": (255, 0, 0, 255), "icon-size": 1.0, "icon-rotate": 0.0},
    "paths": {"line-color": (0, 0, 0, 255), "line-width": 1.0, "line-offset": 0.0, "line-opacity": 1.0, "circle-radius": 5.0, "point-color": (0, 0, 0, 255), "icon-size": 1.0, "icon-rotate": 0.0},
}


class StyleError(ValueError):
    pass


@dataclass
class Layer:
    """Properties by name as JSON; fixed holds the strictly typed ones."""

    id: str
    source: str | None = None
    properties: dict[str, Any] = field(default_factory=dict)
    fixed: dict[str, Any] = field(default_factory=dict)
    filter: Any = None
    min_zoom: float | None = None
    max_zoom: float | None = None


@dataclass
class Style:
    name: str
    layers: list[Layer]


def _list_of(value: Any, kind: type | tuple[type, ...], n: int | None, what: str) -> list | None:
    if value is None:
        return None
    if not isinstance(value, list) or (n and len(value) != n) or not all(isinstance(x, kind) and not isinstance(x, bool) for x in value):
        raise StyleError(f"{what} has a wrong type")
    return value


def parse_style(document: str | dict[str, Any], extended: bool = False) -> Style:
    """A style from JSON. Unknown fields and properties in the wrong block are ignored; the strictly typed ones fail the style.

    extended also reads a layer's filter, minzoom and maxzoom, which the plain form leaves out.
    """
    try:
        root = json.loads(document) if isinstance(document, str) else document
    except json.JSONDecodeError as e:
        raise StyleError(str(e)) from e
    if not isinstance(root, dict) or not isinstance(root.get("layers"), list):
        raise StyleError("layers are missing")
    layers = []
    for x in root["layers"]:
        if not isinstance(x, dict) or not isinstance(x.get("id"), str):
            raise StyleError("a layer needs an id")
        paint, layout = x.get("paint") or {}, x.get("layout") or {}
        properties = {k: paint.get(k) for k in ("line-color", "circle-radius", "line-width", "line-offset", "line-opacity", "text-color")}
        properties["fill-color"] = paint.get("fill-color", paint.get("circle-color"))
        properties |= {k: layout.get(k) for k in ("icon-image", "icon-size", "icon-rotate", "text-field", "text-size")}
        fixed = {
            "line-dasharray": _list_of(paint.get("line-dasharray"), (int, float), None, "line-dasharray"),
            "icon-offset": _list_of(layout.get("icon-offset"), (int, float), 2, "icon-offset"),
            "text-font": _list_of(layout.get("text-font"), str, None, "text-font"),
        }
        for name, values in ENUMS.items():
            fixed[name] = layout.get(name) if layout.get(name) in values else values[0]
        more = {"filter": x.get("filter"), "min_zoom": x.get("minzoom"), "max_zoom": x.get("maxzoom")} if extended else {}
        layers.append(Layer(x["id"], x.get("source"), properties, fixed, **more))
    return Style(root.get("name") or "untitled", layers)


def resolve(layer: Layer, name: str, context: Context) -> Column | None:
    """A property's column of its own kind: null where it has another kind at run time, None if it can't be compiled."""
    x = layer.properties.get(name)
    kind = COLOR if name in COLORS else NUMBER if name in NUMBERS else STRING
    if x is None:
        return None
    if isinstance(x, list):
        value = compile_expression(x, context)
    elif kind == STRING:
        value = Value(STRING, F.lit(x)) if isinstance(x, str) else None
    else:
        value = literal(x) if isinstance(x, str | int | float) and not isinstance(x, bool) else None
    if value is None:
        return None
    column = value.column if value.kind == kind else F.lit(None).cast(SQL_TYPES[kind])
    return column.cast("float").cast("double") if kind == NUMBER else column


def column_name(name: str) -> str:
    return name.replace("-", "_")


def project_layer(df: DataFrame, layer: Layer, order: int, zoom: float | Column = 0.0, profile: str = "pixels", functions: Mapping[str, Function] | None = None, keep: tuple[str, ...] = ("fid",)) -> DataFrame:
    """Features under one layer: keep, layer_ord, layer_id, and each property with its default."""
    context = Context.of(df, zoom, functions)
    defaults = DEFAULTS[profile]
    columns: list[Column] = []
    for name in (*COLORS, *NUMBERS, *STRINGS):
        kind = COLOR if name in COLORS else NUMBER if name in NUMBERS else STRING
        found = resolve(layer, name, context)
        out = found if found is not None else F.lit(None).cast(SQL_TYPES[kind])
        if name in defaults and (name != "line-color" or profile == "pixels"):
            value = defaults[name]
            out = F.coalesce(out, color(*value) if isinstance(value, tuple) else F.lit(value))
        columns.append(out.alias(column_name(name)))
    rows = df
    if layer.filter is not None:
        chosen = compile_expression(layer.filter, context)
        rows = rows.filter(chosen.column if chosen is not None and chosen.kind == "boolean" else F.lit(False))
    if layer.min_zoom is not None or layer.max_zoom is not None:
        rows = rows.filter((context.zoom >= (layer.min_zoom or 0.0)) & (context.zoom < (layer.max_zoom if layer.max_zoom is not None else 99.0)))
    out = rows.select(*keep, F.lit(order).alias("layer_ord"), F.lit(layer.id).alias("layer_id"), *columns)
    if profile == "paths":
        # a line without colour takes the fill's, then black
        out = out.withColumn("line_color", F.coalesce("line_color", "fill_color", color(*defaults["line-color"])))
    return out


def apply_style(df: DataFrame, style: Style, zoom: float | Column = 0.0, profile: str = "pixels", functions: Mapping[str, Function] | None = None, keep: tuple[str, ...] = ("fid",), source_col: str | None = None) -> DataFrame:
    """All layers over all features: a union of projections, never a join. Paint order is (layer_ord, fid).

    With source_col a layer sees only the features of its source.
    """
    if not style.layers:
        raise StyleError("a style needs a layer")
    parts = []
    for i, layer in enumerate(style.layers):
        rows = df.filter(F.col(source_col) == layer.source) if source_col and layer.source is not None else df
        parts.append(project_layer(rows, layer, i, zoom, profile, functions, keep))
    return reduce(DataFrame.unionByName, parts)


def with_sprites(styled: DataFrame, sprites: DataFrame, name_col: str = "name") -> DataFrame:
    """A left join of resolved icon names with a table of sprites; has_icon is false where a circle stands in.

    Spark broadcasts the sprites by their size, or shuffles.
    """
    s = sprites.withColumnRenamed(name_col, "_sprite").withColumn("_there", F.lit(True))
    return styled.join(s, F.col("icon_image") == F.col("_sprite"), "left").withColumn("has_icon", F.coalesce("_there", F.lit(False))).drop("_sprite", "_there")


def color_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit("rgba("), F.concat_ws(",", *[c[p].cast("string") for p in "rgba"]), F.lit(")")))
