"""More registered queries: expression forms, sources, geometry, drawing, classes and pages, each with its SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions import values
from cartolake.operators import classify, cluster, density, geometry, labels, raster, render, scratch, svg, temporal, tiles
from cartolake.plans import sld
from cartolake.plans.page import Page
from cartolake.plans.rules import cascade
from cartolake.plans.style import apply_style, color_text, parse_style
from cartolake.queries import POINTS_SQL, expr, points, query, read
from cartolake.sources import canvases, drawing_info, geojson, vector_tiles

# expressions


@query("SELECT event_id, value IS NOT NULL AS has_value, coalesce(event_type <> 'click', TRUE) AS no_click, coalesce(value >= 50, FALSE) AS at_least, coalesce(value < 50, FALSE) AS below, coalesce(value <= 50, FALSE) AS at_most, 8.5e0 AS next_zoom, 'none' AS no_id, coalesce(value, 0) <> 0 AS as_boolean, 'Point' AS shape, 3e0 AS items, coalesce(value, -1e0) AS value_or FROM events")
def expr_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("geometry_type", F.lit("Point"))
    v = ["get", "value"]
    found = {
        "has_value": ["has", "value"],
        "no_click": ["!=", ["get", "event_type"], "click"],
        "at_least": [">=", v, 50],
        "below": ["<", v, 50],
        "at_most": ["<=", v, 50],
        "next_zoom": ["+", ["zoom"], 1],
        "no_id": ["coalesce", ["id"], "none"],
        "as_boolean": ["to-boolean", v],
        "shape": ["geometry-type"],
        "items": ["fn", "len", ["literal", [1, "a", True]]],
        "value_or": ["fn", "if_null", v, -1],
    }
    return df.select("event_id", *[expr(df, x, 7.5).alias(k) for k, x in found.items()])


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'rgba(255,0,0,255)' WHEN 1 THEN 'rgba(0,255,0,255)' WHEN 2 THEN 'rgba(1,2,3,255)' WHEN 3 THEN 'rgba(1,2,3,127)' WHEN 4 THEN 'rgba(17,34,51,68)' END AS read_color, CASE WHEN p_size > 25 THEN 'rgba(0,128,0,255)' ELSE 'rgba(170,187,204,255)' END AS literal_color FROM part")
def expr_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, short and long hex, rgb() and rgba() texts of a column, and literals that look like colours."""
    k = F.col("p_partkey") % 6
    css = F.when(k == 0, " Red ").when(k == 1, "#0f0").when(k == 2, "rgb(1, 2, 3)").when(k == 3, "rgba(1,2,3,0.5)").when(k == 4, "#11223344").otherwise("nonsense")
    df = read(spark, sf_dir, "part").withColumn("css", css)
    return df.select("p_partkey", expr(df, ["to-color", ["get", "css"]]).alias("read_color"), expr(df, ["case", [">", ["get", "p_size"], 25], "green", "#abc"]).alias("literal_color"))


@query("SELECT p_partkey, round(pow(p_size::DOUBLE, 1.5e0), 6) AS power, round(log10(p_size::DOUBLE), 9) AS decimal_log FROM part")
def fn_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.select("p_partkey", F.round(expr(df, ["fn", "pow", ["get", "p_size"], 1.5]), 6).alias("power"), F.round(expr(df, ["fn", "log10", ["get", "p_size"]]), 9).alias("decimal_log"))


def _bezier_sql() -> str:
    x1, y1, x2, y2 = "0.42e0", "0e0", "0.58e0", "1e0"
    at = lambda a, b: f"(3 * {a} * t * (1 - t) * (1 - t) + 3 * {b} * t * t * (1 - t) + t * t * t)"
    slope = f"(3 * {x1} * (1 - t) * (1 - t) + 6 * ({x2} - {x1}) * t * (1 - t) + 3 * (1 - {x2}) * t * t)"
    rows = "SELECT p_partkey, p_size / 50e0 AS x, p_size / 50e0 AS t FROM part"
    for _ in range(8):
        rows = f"SELECT p_partkey, x, CASE WHEN abs({slope}) < 1e-12 THEN t ELSE least(1e0, greatest(0e0, t - ({at(x1, x2)} - x) / {slope})) END AS t FROM ({rows})"
    return f"SELECT p_partkey, round(CASE WHEN x >= 1 THEN 100e0 ELSE 100 * {at(y1, y2)} END, 6) AS eased FROM ({rows})"


@query(_bezier_sql())
def style_interpolate_bezier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.select("p_partkey", F.round(expr(df, ["interpolate", ["cubic-bezier", 0.42, 0, 0.58, 1], ["get", "p_size"], 0, 0, 50, 100]), 6).alias("eased"))


# styles, rules


@query("SELECT p_partkey, 'plain' AS layer, 'rgba(0,0,0,255)' AS line, 1e0 AS width, 0e0 AS line_offset, 5e0 AS radius, 'round' AS cap, 'miter' AS line_join FROM part UNION ALL SELECT p_partkey, 'wide', 'rgba(0,0,255,255)', p_size::DOUBLE, 2.5e0, 5e0, 'butt', 'bevel' FROM part")
def style_path_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of the path profile and enumerations of the layout, where an unknown cap is the first."""
    style = parse_style(json.dumps({"layers": [{"id": "plain", "layout": {"line-cap": "round"}}, {"id": "wide", "layout": {"line-cap": "wavy", "line-join": "bevel"}, "paint": {"line-color": "blue", "line-width": ["get", "p_size"], "line-offset": 2.5}}]}))
    out = apply_style(read(spark, sf_dir, "part"), style, profile="paths", keep=("p_partkey",))
    fixed = {x.id: x.fixed for x in style.layers}
    pick = lambda k: F.when(F.col("layer_id") == "plain", fixed["plain"][k]).otherwise(fixed["wide"][k])
    return out.select("p_partkey", F.col("layer_id").alias("layer"), color_text(F.col("line_color")).alias("line"), F.col("line_width").alias("width"), "line_offset", F.col("circle_radius").alias("radius"), pick("line-cap").alias("cap"), pick("line-join").alias("line_join"))


SLD = """<StyledLayerDescriptor xmlns="http://www.opengis.net/sld" xmlns:se="http://www.opengis.net/se" xmlns:ogc="http://www.opengis.net/ogc" version="1.1.0"><NamedLayer><se:Name>orders</se:Name><UserStyle><se:FeatureTypeStyle>
<se:Rule><se:Name>all</se:Name><se:LineSymbolizer><se:Stroke/></se:LineSymbolizer><se:PolygonSymbolizer/></se:Rule>
<se:Rule><se:Name>done</se:Name><ogc:Filter><ogc:PropertyIsEqualTo><ogc:PropertyName>o_orderstatus</ogc:PropertyName><ogc:Literal>F</ogc:Literal></ogc:PropertyIsEqualTo></ogc:Filter><se:LineSymbolizer><se:Stroke><se:SvgParameter name="stroke">#00ff00</se:SvgParameter><se:SvgParameter name="stroke-width">3</se:SvgParameter></se:Stroke></se:LineSymbolizer></se:Rule>
<se:Rule><se:Name>dear</se:Name><ogc:Filter><ogc:And><ogc:PropertyIsGreaterThan><ogc:PropertyName>o_totalprice</ogc:PropertyName><ogc:Literal>200000</ogc:Literal></ogc:PropertyIsGreaterThan><ogc:Not><ogc:PropertyIsLessThan><ogc:PropertyName>o_custkey</ogc:PropertyName><ogc:Literal>100</ogc:Literal></ogc:PropertyIsLessThan></ogc:Not></ogc:And></ogc:Filter><se:PolygonSymbolizer><se:Fill><se:SvgParameter name="fill">#ff0000</se:SvgParameter><se:SvgParameter name="fill-opacity">0.5</se:SvgParameter></se:Fill></se:PolygonSymbolizer></se:Rule>
<se:Rule><se:Name>near</se:Name><se:MaxScaleDenominator>1000</se:MaxScaleDenominator><se:LineSymbolizer><se:Stroke><se:SvgParameter name="stroke">#123456</se:SvgParameter></se:Stroke></se:LineSymbolizer></se:Rule>
</se:FeatureTypeStyle></UserStyle></NamedLayer></StyledLayerDescriptor>"""


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '#00ff00' ELSE '#000000' END AS line, CASE WHEN o_orderstatus = 'F' THEN 3e0 ELSE 1e0 END AS width, CASE WHEN o_totalprice > 200000 AND o_custkey >= 100 THEN '#ff0000' ELSE '#cccccc' END AS fill, CASE WHEN o_totalprice > 200000 AND o_custkey >= 100 THEN 0.5e0 ELSE 1e0 END AS opacity, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'all' END AS line_from FROM orders")
def sld_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from a styled layer descriptor, over orders; the last one is for nearer zooms."""
    out = cascade(read(spark, sf_dir, "orders"), sld.parse_sld(SLD), 8.0)
    return out.select("o_orderkey", F.col("line-color").alias("line"), F.col("line-width").alias("width"), F.col("fill-color").alias("fill"), F.col("fill-opacity").alias("opacity"), F.col("sources")["line-color"].alias("line_from"))


@query("SELECT n_name AS rule, n_nationkey AS priority, CASE WHEN n_nationkey % 3 > 0 THEN round(log2(559082264 / (n_nationkey * 1000e0)), 4) END AS min_zoom, CASE WHEN n_nationkey % 2 = 0 THEN '#0000' || printf('%02x', n_nationkey) END AS line, CASE WHEN n_nationkey % 2 = 1 THEN '#' || printf('%02x', n_nationkey) || '0000' END AS fill, CASE WHEN n_nationkey % 2 = 1 THEN 0.5e0 END AS opacity FROM nation")
def sld_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of line and fill rules, one a nation, written and read again."""
    named = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    par = lambda k, v: f'<se:SvgParameter name="{k}">{v}</se:SvgParameter>'

    def rule(n: int, name: str) -> str:
        scale = f"<se:MaxScaleDenominator>{n * 1000}</se:MaxScaleDenominator>" if n % 3 else ""
        line = f"<se:LineSymbolizer><se:Stroke>{par('stroke', f'#0000{n:02x}')}</se:Stroke></se:LineSymbolizer>"
        fill = f"<se:PolygonSymbolizer><se:Fill>{par('fill', f'#{n:02x}0000')}{par('fill-opacity', '0.5')}</se:Fill></se:PolygonSymbolizer>"
        return f"<se:Rule><se:Name>{name}</se:Name>{scale}{fill if n % 2 else line}</se:Rule>"

    head, tail = SLD[: SLD.index("<se:Rule>")], SLD[SLD.rindex("</se:Rule>") + len("</se:Rule>") :]
    text = head + "".join(rule(r["n_nationkey"], r["n_name"]) for r in named) + tail
    again = sld.parse_sld(sld.to_sld(sld.parse_sld(text), "a <layer> & more"))
    value = lambda r, k: r.values[k][1] if k in r.values else None
    rows = [(r.name, r.priority, None if r.min_zoom is None else round(r.min_zoom, 4), value(r, "line-color"), value(r, "fill-color"), value(r, "fill-opacity")) for r in again]
    return spark.createDataFrame(rows, "rule string, priority int, min_zoom double, line string, fill string, opacity double")


@query("SELECT o_orderkey, round(CASE WHEN s > 0 THEN log2(559082264 / s) ELSE 0 END, 9) AS zoom FROM (SELECT o_orderkey, (o_orderkey % 100 * 1000)::DOUBLE AS s FROM orders)")
def scale_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(sld.zoom_of_scale((F.col("o_orderkey") % 100 * 1000).cast("double")), 9).alias("zoom"))


# sources


@query(f"SELECT class || '.json' AS file, row_number() OVER (PARTITION BY class ORDER BY fid) - 1 AS place, fid, round(x, 6) AS x, round(y, 6) AS y, weight FROM {POINTS_SQL}")
def geojson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one collection file for each type, written in streams and read back in pieces that cut features anywhere."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct("fid", "weight").alias("properties"))
    folder = scratch.folder(spark)
    canvases.write_collections(points(spark, sf_dir).select(F.col("class").alias("canvas"), "fid", F.to_json(feature).alias("text")), folder)
    back = geojson.read_pieces(spark, folder + "/part-*", points_only=True, piece=1 << 20)
    at = F.get("geom.paths", F.lit(0))["pts"][0]
    value = lambda k, t: F.try_variant_get("props", f"$.{k}", t).alias(k)
    return back.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.col("fid").alias("place"), value("fid", "long"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"), value("weight", "double"))


@query(f"SELECT fid AS doc, 0 AS place, 'Point' AS shape, x, y, 0e0 AS length, 'v' || (fid % 3) AS tag FROM {POINTS_SQL} UNION ALL SELECT fid, 1, 'LineString', 0, 0, round(sqrt(x * x + y * y), 6), NULL FROM {POINTS_SQL} UNION ALL SELECT fid, 4, 'Polygon', 0, 0, 12, NULL FROM {POINTS_SQL}")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of five features for each event, of which one has broken coordinates and one none."""
    feature = lambda kind, coordinates, props: F.concat(F.lit('{"type":"Feature","geometry":{"type":"' + kind + '","coordinates":'), coordinates, F.lit('},"properties":'), props, F.lit("}"))
    place = F.concat(F.lit("["), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]"))
    tag = F.concat(F.lit('{"tag":"v'), (F.col("fid") % 3).cast("string"), F.lit('"}'))
    none = F.lit("null")
    parts = [feature("Point", place, tag), feature("LineString", F.concat(F.lit("[[0,0],"), place, F.lit("]")), none), feature("Point", F.lit('["a",1]'), none), F.lit('{"type":"Feature","geometry":null,"properties":null}'), feature("Polygon", F.lit("[[[0,0],[4,0],[4,2],[0,2],[0,0]]]"), none)]
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", *parts), F.lit("]}"))
    docs = points(spark, sf_dir).select("fid", F.from_json(text, f"type string, features array<{geojson._FEATURE}>").alias("d"))
    out = geojson.features_of(docs.select(F.col("fid").alias("doc"), "d.features"), keep=("doc",))
    first = F.get(geometry.vertices(F.col("geom")), F.lit(0))
    return out.select("doc", F.col("fid").alias("place"), F.col("geometry_type").alias("shape"), first["x"].alias("x"), first["y"].alias("y"), F.round(geometry.length(F.col("geom")), 6).alias("length"), F.try_variant_get("props", "$.tag", "string").alias("tag"))


@query(f"SELECT 'data' AS box, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM {POINTS_SQL} UNION ALL SELECT 'one', min(x) - 1, min(y) - 1, min(x) + 1, min(y) + 1 FROM (SELECT x, y FROM {POINTS_SQL} WHERE fid = (SELECT min(fid) FROM {POINTS_SQL})) UNION ALL SELECT 'text', -1.5, 2, 3, 4e0")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir)
    one = df.filter(F.col("fid") == df.agg(F.min("fid")).first()[0])
    rows = [("data", *geojson.auto_bbox(df)), ("one", *geojson.auto_bbox(one)), ("text", *geojson.parse_bbox("-1.5,2,3,4"))]
    return spark.createDataFrame(rows, "box string, min_x double, min_y double, max_x double, max_y double")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _drawn(*steps: tuple[int, list[tuple[int, int]]]) -> bytes:
    """Commands (1 move, 2 line, 7 close) with relative places."""
    out = b""
    for command, places in steps:
        out += _varint(command | max(1, len(places)) << 3)
        for x, y in places:
            out += _varint(x << 1 ^ x >> 31) + _varint(y << 1 ^ y >> 31)
    return out


def _shapes_tile(k: int, name: str) -> bytes:
    """Two layers: points, lines and polygons, k times as large, with all kinds of values, and an empty one."""
    draw = lambda *steps: _drawn(*[(c, [(x * k, y * k) for x, y in places]) for c, places in steps])
    field = lambda n, b: _varint(n << 3 | 2) + _varint(len(b)) + b
    square = lambda x, y, s: [(1, [(x, y)]), (2, [(s, 0), (0, s), (-s, 0)]), (7, [])]
    back = lambda x, y, s: [(1, [(x, y)]), (2, [(0, s), (s, 0), (0, -s)]), (7, [])]
    shapes = [
        (1, draw((1, [(64, 64), (64, 0)])), b"\x00\x00"),
        (2, draw((1, [(0, 0)]), (2, [(128, 0), (0, 128)])), b"\x01\x01"),
        (2, draw((1, [(0, 0)]), (2, [(128, 0)]), (1, [(0, 64)]), (2, [(-64, 0)])), b"\x02\x02"),
        (3, draw(*square(0, 0, 128)), b"\x00\x03\x09\x09"),
        (3, draw(*square(0, 0, 128), *back(32, -96, 64)), b"\x01\x04"),
        (3, draw(*square(0, 0, 64), *square(64, 0, 64)), b"\x02\x05"),
    ]
    import struct

    found = [field(1, name.encode()), _varint(5 << 3) + _varint(7), _varint(3 << 3 | 1) + struct.pack("<d", 2.5), _varint(6 << 3) + _varint(9), _varint(7 << 3) + b"\x01", _varint(2 << 3 | 5) + struct.pack("<f", 0.25)]
    features = [field(2, field(2, tags) + b"\x18" + bytes([kind]) + field(4, commands)) for kind, commands, tags in shapes]
    layer = field(1, b"shapes") + b"".join(features) + b"".join(field(3, k) for k in (b"a", b"b", b"c")) + b"".join(field(4, v) for v in found) + b"\x28" + _varint(256)
    return field(3, layer) + field(3, field(1, b"other"))


def _part_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"path": b["p_partkey"].astype(str), "content": [_shapes_tile(1 + n % 3, brand) for n, brand in zip(b["p_partkey"], b["p_brand"], strict=True)]})


@query("SELECT p_partkey::VARCHAR AS path, fid, kind, vertices, length * k AS length, area * k * k AS area, CASE WHEN named THEN p_brand END AS a, c, b FROM (VALUES (0, 'MultiPoint', 2, 0e0, 0e0, TRUE, NULL::DOUBLE, NULL::BOOLEAN), (1, 'LineString', 3, 1e0, 0e0, NULL, NULL, NULL), (2, 'MultiLineString', 4, 0.75e0, 0e0, NULL, 2.5e0, NULL), (3, 'Polygon', 5, 2e0, 0.25e0, NULL, NULL, NULL), (4, 'Polygon', 10, 3e0, 0.1875e0, NULL, NULL, TRUE), (5, 'MultiPolygon', 10, 2e0, 0.125e0, NULL, 0.25e0, NULL)) t(fid, kind, vertices, length, area, named, c, b), (SELECT *, 1 + p_partkey % 3 AS k FROM part)")
def mvt_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile a part: points, lines, a hole by its winding, and two parts, in a layer found by name; tags that point nowhere are dropped."""
    files = scratch.spread(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").mapInPandas(_part_tiles, "path string, content binary")
    g = F.col("geom")
    out = vector_tiles.decode_tiles(files).filter(F.col("layer") == "shapes")
    return out.select("path", "fid", F.col("geom.kind").alias("kind"), F.size(geometry.vertices(g)).alias("vertices"), geometry.length(g).alias("length"), geometry.area(g).alias("area"), vector_tiles.prop("a", "string").alias("a"), vector_tiles.prop("c", "number").alias("c"), vector_tiles.prop("b", "boolean").alias("b"))


_UNIQUE = '{"renderer":{"type":"uniqueValue","field1":"A","field2":"B","fieldDelimiter":"-","defaultSymbol":{"type":"esriSLS","style":"esriSLSSolid","color":[0,0,0,255],"width":0.75},"uniqueValueInfos":[{"value":"x-1","symbol":{"type":"esriSLS","style":"esriSLSDash","color":[255,0,0,255],"width":1.5}}]},"transparency":25}'
_FILL = '{"renderer":{"type":"simple","symbol":{"type":"esriSFS","style":"esriSFSForwardDiagonal","color":[1,2,3,128],"outline":{"type":"esriSLS","style":"esriSLSSolid","color":[9,9,9,255],"width":1}}}}'
_LABEL = '{"renderer":{"type":"simple","symbol":{"type":"esriSMS","style":"esriSMSSquare","color":[1,2,3,255]}},"labelingInfo":[{"labelExpression":"[NAME]","labelPlacement":"esriServerPointLabelPlacementAboveRight","symbol":{"color":[0,0,255,255],"font":{"size":9},"haloColor":[255,255,255,255],"haloSize":1.5}}]}'


def _esri_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents a part, with its brand as a value and its size in colours."""
    kinds = [("u", "Line", _UNIQUE), ("f", "Polygon", _FILL), ("m", "Point", _LABEL)]
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("g"), F.lit(d).alias("d")) for k, g, d in kinds])).alias("s")
    text = F.replace(F.replace("s.d", F.lit("x-1"), "p_brand"), F.lit("[1,2,3,"), F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(",2,3,")))
    return scratch.spread(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select("p_partkey", "p_brand", "p_size", every).select(F.concat("s.k", "p_partkey").alias("id"), F.col("s.g").alias("geometry"), text.alias("info_json"))


_MATCH = """'["match",["concat",["to-string",["get","A"]],"-",["to-string",["get","B"]]],"' || p_brand || '",'"""


@query(f"""SELECT kind || p_partkey || layer AS layer, prop, value FROM (
 SELECT p_partkey, unnest([
  {{'kind': 'u', 'layer': '-line', 'prop': 'line-color', 'value': {_MATCH} || '"rgba(255,0,0,1)","rgba(0,0,0,1)"]'}},
  {{'kind': 'u', 'layer': '-line', 'prop': 'line-width', 'value': {_MATCH} || '2.0,1.0]'}},
  {{'kind': 'u', 'layer': '-line', 'prop': 'line-opacity', 'value': '0.75'}},
  {{'kind': 'u', 'layer': '-line', 'prop': 'line-dasharray', 'value': '[4.0,3.0]'}},
  {{'kind': 'f', 'layer': '-fill', 'prop': 'fill-color', 'value': '"rgba(' || p_size || ',2,3,0.502)"'}},
  {{'kind': 'f', 'layer': '-outline', 'prop': 'line-color', 'value': '"rgba(9,9,9,1)"'}},
  {{'kind': 'f', 'layer': '-outline', 'prop': 'line-width', 'value': '1.33'}},
  {{'kind': 'm', 'layer': '-circle', 'prop': 'circle-color', 'value': '"rgba(' || p_size || ',2,3,1)"'}},
  {{'kind': 'm', 'layer': '-circle', 'prop': 'circle-radius', 'value': '5.33'}}], recursive := true) FROM part)""")
def esri_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique values over two fields with a default, the first dash pattern, opacity from transparency, a hatched fill with an outline, and a default size."""
    out = drawing_info.layers(_esri_docs(spark, sf_dir))
    return out.select("layer", F.explode("properties").alias("prop", "value"))


@query("""SELECT t.id || p_partkey AS id, path, reason FROM part, (VALUES ('f', 'renderer.symbol', 'a hatch becomes solid'), ('m', 'renderer.symbol', 'drawn as a circle'),
 ('u', 'renderer.symbol.style', 'one dash pattern for all classes, the first is taken')) t(id, path, reason)""")
def esri_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing_info.losses(_esri_docs(spark, sf_dir))


@query("""SELECT 'm' || p_partkey AS id, '["concat",["to-string",["get","NAME"]]]' AS text_field, 12e0 AS size, 'rgba(0,0,255,1)' AS color, 'rgba(255,255,255,1)' AS halo_color, 2e0 AS halo_width FROM part""")
def esri_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing_info.labels(_esri_docs(spark, sf_dir)).select("id", "text_field", "size", "color", "halo_color", "halo_width")


# geometry, tiles, time

_WH = "(SELECT o_orderkey AS fid, (1 + o_custkey % 7)::DOUBLE AS w, (1 + o_orderkey % 5)::DOUBLE AS h FROM orders)"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch.spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(F.col("o_orderkey").alias("fid"), (1 + F.col("o_custkey") % 7).cast("double").alias("w"), (1 + F.col("o_orderkey") % 5).cast("double").alias("h"))


@query(f"SELECT fid, w * 10 AS screen_x, (6 - h) * 10 AS screen_y, w > 1.5 AND h > 0.5 AS inside, w AS mid_x, h / 2 AS mid_y, round(pi() / 2, 9) AS angle, TRUE AS beyond, round(w - sqrt(2e0), 9) AS off_x, round(sqrt(2e0), 9) AS off_y, w - 2 AS end_x FROM {_WH}")
def geom_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map to screen, point in polygon, a place along a line and beyond its end, and a line moved sideways."""
    rows = _sized(spark, sf_dir)
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    rows = rows.withColumns({"ring": F.array(geometry.point(zero, zero), geometry.point(w, zero), geometry.point(w, h), geometry.point(zero, h)), "line": F.array(geometry.point(zero, zero), geometry.point(w, zero), geometry.point(w, h))})
    rows = rows.withColumns({"s": F.get(geometry.to_screen(F.array(geometry.point(w, h)), (0.0, 0.0, 8.0, 6.0), 80, 60), F.lit(0)), "m": geometry.at_distance(F.col("line"), w + h / 2), "o": geometry.offset_line(F.col("line"), 2.0)})
    corner, end = F.get("o", F.lit(1)), F.get("o", F.lit(2))
    return rows.select("fid", F.col("s.x").alias("screen_x"), F.col("s.y").alias("screen_y"), geometry.contains(F.col("ring"), F.lit(1.5), F.lit(0.5)).alias("inside"), F.col("m.x").alias("mid_x"), F.col("m.y").alias("mid_y"), F.round("m.angle", 9).alias("angle"), geometry.at_distance(F.col("line"), w + h + 1).isNull().alias("beyond"), F.round(corner["x"], 9).alias("off_x"), F.round(corner["y"], 9).alias("off_y"), F.round(end["x"], 9).alias("end_x"))


@query(f"SELECT fid, k, CASE k WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' WHEN 3 THEN 'MultiPoint' WHEN 4 THEN 'MultiLineString' ELSE 'MultiPolygon' END AS kind, TRUE AS same, CASE k WHEN 2 THEN w * h - 0.25 WHEN 5 THEN w * h * 2 ELSE 0 END AS area, CASE k WHEN 1 THEN w + h WHEN 2 THEN 2 * (w + h) + 2 WHEN 4 THEN w + h WHEN 5 THEN 4 * (w + h) ELSE 0 END AS length, CASE k WHEN 0 THEN w WHEN 1 THEN w * 2 / 3 WHEN 2 THEN w / 2 WHEN 3 THEN w / 2 WHEN 4 THEN w / 4 ELSE w / 2 + 5 END AS cx FROM {_WH}, range(0, 6) t(k)")
def geom_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all six kinds, read, measured, written as text and bytes, and read again."""
    w, h, right = ((F.col(c) + d).cast("int").cast("string") for c, d in (("w", 0), ("h", 0), ("w", 10)))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    box = lambda x, to: (f"({x} 0, ", to, " 0, ", to, " ", h, f", {x} ", h, f", {x} 0)")
    texts = [
        text("POINT (", w, " ", h, ")"),
        text("LINESTRING (0 0, ", w, " 0, ", w, " ", h, ")"),
        text("POLYGON (", *box(0, w), ", (0.25 0.25, 0.25 0.75, 0.75 0.75, 0.75 0.25, 0.25 0.25))"),
        text("MULTIPOINT ((0 0), (", w, " ", h, "))"),
        text("MULTILINESTRING ((0 0, ", w, " 0), (0 0, 0 ", h, "))"),
        text("MULTIPOLYGON ((", *box(0, w), "), (", *box(10, right), "))"),
    ]
    rows = _sized(spark, sf_dir).select("fid", F.posexplode(F.array(*texts)).alias("k", "text"))
    return scratch.once(rows, "text", _read_and_measured).select("fid", F.col("k").cast("long").alias("k"), "kind", "same", "area", "length", "cx")


def _read_and_measured(texts: DataFrame) -> DataFrame:
    rows = texts.withColumn("geom", geometry.from_wkt(F.col("text")))
    rows = geometry.measures(rows, "geom").withColumn("wkb", geometry.to_wkb(F.col("geom")))
    rows = rows.withColumn("back", geometry.from_wkb(F.col("wkb")))
    again = geometry.to_wkt(F.col("back")) == geometry.to_wkt(F.col("geom"))
    return rows.select("text", F.col("geom.kind").alias("kind"), again.alias("same"), F.round("area", 9).alias("area"), F.round("length", 9).alias("length"), F.round("centroid.x", 9).alias("cx"))


# pixels


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("fid") % 8).cast("string")).alias("canvas"), F.lit(0).alias("layer_ord"), "fid", "w", "h", values.color(10, 20, 30, 255).alias("rgba"))


@query(f"SELECT fid, (w * 2)::BIGINT AS butt, ((w + 2) * 2)::BIGINT AS square, ((w + 2) * 2)::BIGINT AS round, (2 * (SELECT count(*) FROM range(0, 8) t(k) WHERE k < w AND (k + 0.5) % 6 < 4))::BIGINT AS dashed FROM {_WH}")
def stroke_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a level line two wide under each cap, and of its dashes."""
    lines = _strips(spark, sf_dir).withColumns({"pts": F.array(geometry.point(F.lit(2), F.lit(4)), geometry.point(F.col("w") + 2, F.lit(4))), "line_width": F.lit(2.0)}).drop("w", "h")
    forms = {"butt": ("butt", None), "square": ("square", None), "round": ("round", None), "dashed": ("butt", [4.0, 2.0])}
    out = None
    for name, (cap, dashes) in forms.items():
        n = raster.strokes(raster.segments(lines, dashes), 16, 16, cap).groupBy("fid").agg(F.countDistinct("px", "py").alias(name))
        out = n if out is None else out.join(n, "fid")
    return out


@query(f"SELECT fid, (2 * w)::BIGINT AS half, ((h - 1) * w)::BIGINT AS full_cover FROM {_WH}")
def smooth_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle half a pixel off: its first and last rows are half covered."""
    corner = lambda x, y: geometry.point(x, y)
    w, low, high, zero = F.col("w"), F.lit(0.5), F.col("h") + 0.5, F.lit(0)
    rows = _strips(spark, sf_dir).withColumn("rings", F.array(F.array(corner(zero, low), corner(w, low), corner(w, high), corner(zero, high)))).drop("w", "h")
    pixels = raster.fills(rows, 16, 16, samples=4)
    return pixels.groupBy("fid").agg(F.count_if(F.col("rgba.a") == 127).alias("half"), F.count_if(F.col("rgba.a") == 255).alias("full_cover"))


@query(f"WITH p AS (SELECT fid, (x + 180) * (256 / 360e0) AS x, (85 - y) * (256 / 170e0) AS y FROM {POINTS_SQL}), d AS (SELECT fid, floor(x) + a AS px, floor(y) + b AS py, least(1e0, greatest(0e0, 4e0 - sqrt(power(floor(x) + a + 0.5e0 - x, 2) + power(floor(y) + b + 0.5e0 - y, 2)))) AS c FROM p, range(-5, 6) s(a), range(-5, 6) t(b)) SELECT fid, count(*) AS pixels, sum(floor(255 * c))::BIGINT AS alpha FROM d WHERE c > 0 AND px BETWEEN 0 AND 255 AND py BETWEEN 0 AND 255 GROUP BY fid")
def smooth_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select(F.lit("all").alias("canvas"), F.lit(0).alias("layer_ord"), "fid", ((F.col("x") + 180) * (256 / 360.0)).alias("x"), ((F.lit(85.0) - F.col("y")) * (256 / 170.0)).alias("y"), F.lit(3.5).alias("radius"), values.color(0, 0, 0, 255).alias("rgba"))
    return raster.discs(rows, 256, 256, smooth=True).groupBy("fid").agg(F.count("*").alias("pixels"), F.sum("rgba.a").cast("long").alias("alpha"))


@query(f"WITH p AS (SELECT fid, trunc((x + 180) * (256 / 360e0))::INT AS cx, trunc((85 - y) * (256 / 170e0))::INT AS cy, class FROM {POINTS_SQL}), d AS (SELECT fid, cx + a AS px, cy + b AS py, class FROM p, range(-2, 3) s(a), range(-2, 3) t(b) WHERE a * a + b * b <= 4) SELECT px::INT AS px, py::INT AS py, arg_max(CASE WHEN class = 'click' THEN 'rgba(255,0,0,255)' ELSE 'rgba(136,136,136,255)' END, fid) AS color FROM d WHERE px BETWEEN 0 AND 255 AND py BETWEEN 0 AND 255 GROUP BY 1, 2")
def render_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style drawn over events as points: layers, screen, discs and pixels in one call."""
    df = points(spark, sf_dir)
    features = df.select("fid", "class", geometry.geometry("Point", F.array(geometry.point(F.col("x"), F.col("y")))).alias("geom"))
    style = parse_style({"layers": [{"id": "dots", "paint": {"circle-color": ["match", ["get", "class"], "click", "#ff0000", "#888888"], "circle-radius": 2}}]})
    out = render.render(features, style, (-180.0, -85.0, 180.0, 85.0), 256, 256)
    return out.select("px", "py", color_text(F.col("rgba")).alias("color"))


@query(f"SELECT fid, CASE k WHEN 0 THEN 'rgba(0,0,255,255)' ELSE 'rgba(255,0,0,127)' END AS color, CASE k WHEN 0 THEN w * h * 4 ELSE w * 2 * 2 END::BIGINT AS pixels FROM {_WH}, range(0, 2) t(k)")
def render_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills and lines of a style: a blue rectangle on the left half and a half-clear red line on the right, two pixels a unit."""
    rows = _sized(spark, sf_dir)
    corner = lambda x, y: geometry.point(x, y)
    w, h, zero = F.col("w"), F.col("h"), F.lit(0)
    ring = geometry.geometry("Polygon", F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h), corner(zero, zero)))
    line = geometry.geometry("LineString", F.array(corner(F.lit(10), F.lit(2)), corner(w + 10, F.lit(2))))
    own = lambda geom: rows.select("fid", F.col("fid").cast("string").alias("canvas_id"), geom.alias("geom"))
    style = parse_style({"layers": [{"id": "shapes", "paint": {"fill-color": "blue"}}, {"id": "lines", "paint": {"line-color": "red", "line-width": 2, "line-opacity": 0.5}}]})
    one = lambda f, s: render.render_runs(f, s, (0.0, 0.0, 20.0, 8.0), 40, 16, 0.0, "canvas_id")
    first, second = style.layers
    style.layers = [first]
    filled = one(own(ring), style)
    style.layers = [second]
    out = filled.unionByName(one(own(line), style))
    pixels = out.groupBy("canvas", "rgba").agg(F.sum(F.col("b") - F.col("a") + 1).alias("pixels"))
    return pixels.select(F.col("canvas").cast("long").alias("fid"), color_text(F.col("rgba")).alias("color"), "pixels")


# labels, pages


@query("SELECT p_partkey, ceil(p_size / 3e0)::BIGINT AS lines, CASE WHEN p_size >= 3 THEN 'abc abc abc' WHEN p_size = 2 THEN 'abc abc' ELSE 'abc' END AS first FROM part")
def label_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three letters on lines of at most eleven."""
    rows = read(spark, sf_dir, "part").select("p_partkey", labels.wrap(F.repeat(F.lit("abc "), F.col("p_size").cast("int")), 11.5, 0.2).alias("l"))
    return rows.select("p_partkey", F.size("l").cast("long").alias("lines"), F.get("l", F.lit(0)).alias("first"))


@query(f"SELECT fid, CASE WHEN 4 <= w * 0.8 THEN (w - 4) / 2 + 1 END AS first_x, CASE WHEN 4 <= w * 0.8 THEN (w - 4) / 2 + 3 END AS second_x, CASE WHEN 4 <= w * 0.8 THEN 1.5e0 END AS y FROM {_WH}")
def label_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two characters centred along a level line, lifted by half; none where the line is too short."""
    pts = F.array(geometry.point(F.lit(0), F.lit(1)), geometry.point(F.col("w"), F.lit(1)))
    rows = _sized(spark, sf_dir).select("fid", labels.along_line(pts, F.lit("ab"), F.array(F.lit(2.0), F.lit(2.0)), 0.5).alias("c"))
    at = lambda i, k: F.round(F.get("c", F.lit(i))[k], 9)
    return rows.select("fid", at(0, "x").alias("first_x"), at(1, "x").alias("second_x"), at(0, "y").alias("y"))


@query("SELECT p_partkey, 'M0.00 0.00 L' || printf('%.2f', p_size::DOUBLE) || ' 0.00 L0.00 1.00 Z' AS path, '<polyline points=\"0.00,0.00 ' || printf('%.2f', p_size::DOUBLE) || ',1.00\" fill=\"none\" stroke=\"red\" stroke-width=\"1.50\"/>' AS line, '<text x=\"1.00\" y=\"2.00\" font-size=\"9.00\" fill=\"black\">&lt;a &amp; &quot;b&quot;&gt; ' || p_size || '</text>' AS label, CASE WHEN p_size > 45 THEN 15e0 WHEN p_size > 20 THEN 10e0 WHEN p_size > 10 THEN 5e0 WHEN p_size > 2 THEN 1e0 WHEN p_size > 1 THEN 0.5e0 ELSE 0.1e0 END AS interval_degrees, CASE WHEN p_size >= 50 THEN 50e0 WHEN p_size >= 20 THEN 20e0 WHEN p_size >= 10 THEN 10e0 WHEN p_size >= 5 THEN 5e0 WHEN p_size >= 2 THEN 2e0 ELSE 1e0 END AS nice FROM part")
def svg_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    s, zero = F.col("p_size").cast("double"), F.lit(0)
    triangle = F.array(F.array(geometry.point(zero, zero), geometry.point(s, zero), geometry.point(zero, F.lit(1))))
    path = F.regexp_extract(svg.polygon(triangle, F.lit("red")), 'd="([^"]*)"', 1)
    line = svg.polyline(F.array(geometry.point(zero, zero), geometry.point(s, F.lit(1))), F.lit("red"), F.lit(1.5))
    text = svg.label(F.lit(1.0), F.lit(2.0), F.lit(9.0), F.lit("black"), F.concat(F.lit('<a & "b"> '), F.col("p_size").cast("string")))
    return rows.select("p_partkey", path.alias("path"), line.alias("line"), text.alias("label"), svg.graticule_interval(s).alias("interval_degrees"), svg.nice_round(s).alias("nice"))


def _part_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pages = [Page("A3" if n % 2 else "A4", landscape=n % 2 == 1, dpi=100.0 + size) for n, size in zip(b["p_partkey"], b["p_size"], strict=True)]
        rows = [(n, p.size, p.landscape, *p.pixels, *p.map_pixels, p.view_box) for n, p in zip(b["p_partkey"], pages, strict=True)]
        yield pd.DataFrame(rows, columns=["p_partkey", "size", "landscape", "width", "height", "map_width", "map_height", "view_box"])


@query("SELECT p_partkey, size, landscape, trunc(w / 25.4e0 * dpi)::INT AS width, trunc(h / 25.4e0 * dpi)::INT AS height, trunc((w - 20) / 25.4e0 * dpi)::INT AS map_width, trunc((h - 20) / 25.4e0 * dpi)::INT AS map_height, '0 0 ' || w || ' ' || h AS view_box FROM (SELECT p_partkey, 100e0 + p_size AS dpi, CASE WHEN p_partkey % 2 = 1 THEN 'A3' ELSE 'A4' END AS size, p_partkey % 2 = 1 AS landscape, CASE WHEN p_partkey % 2 = 1 THEN 420 ELSE 210 END AS w, 297 AS h FROM part)")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a part, at a resolution by its size."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return rows.mapInPandas(_part_pages, "p_partkey long, size string, landscape boolean, width int, height int, map_width int, map_height int, view_box string")
