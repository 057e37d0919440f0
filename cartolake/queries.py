"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions import symbology, values
from cartolake.functions.expressions import Context, compile_expression
from cartolake.functions.registry import FunctionRegistry
from cartolake.operators import classify, cluster, density, geometry, labels, raster, scratch, svg, temporal, terrain, tiles
from cartolake.operators.filters import FilterBuilder
from cartolake.plans.rules import Rule, cascade
from cartolake.plans.style import apply_style, color_text, parse_style, with_sprites
from cartolake.sources import drawing_info, vector_tiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LON = "-180e0 + 360e0 * ((event_id * 7919) % 10007) / 10007e0"
LAT = "-85e0 + 170e0 * ((event_id * 104729) % 10009) / 10009e0"
POINTS_SQL = f"(SELECT event_id AS fid, user_id AS entity, epoch_us(ts) / 1e6 AS t, {LON} AS x, {LAT} AS y, value AS weight, event_type AS class FROM events)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: coordinates follow from their ids."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("fid"), F.col("user_id").alias("entity"), temporal.time_value(e, "ts").alias("t"), F.expr(LON).alias("x"), F.expr(LAT).alias("y"), F.col("value").alias("weight"), F.col("event_type").alias("class"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed rectangles."""
    o = scratch.spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    w, h = F.lit(1) + F.col("o_custkey") % 7, F.lit(1) + F.col("o_orderkey") % 5
    corner = lambda x, y: geometry.point(x, y)
    zero = F.lit(0)
    return o.select(F.col("o_orderkey").alias("fid"), geometry.geometry("Polygon", F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h), corner(zero, zero))).alias("geom"))


def expr(df: DataFrame, x: object, zoom: float = 0.0) -> Column:
    value = compile_expression(x, Context.of(df, zoom, FunctionRegistry.with_builtins()))
    if value is None:
        raise ValueError("the expression can't be compiled")
    return color_text(value.column) if value.kind == "color" else value.column


# expressions


@query("SELECT event_id, CASE WHEN value > 100 THEN 'big' WHEN event_type = 'click' THEN 'click' ELSE 'other' END AS size, CASE event_type WHEN 'click' THEN 'rgba(255,0,0,255)' WHEN 'view' THEN 'rgba(0,128,0,255)' ELSE 'rgba(136,136,136,255)' END AS fill FROM events")
def style_case_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return df.select("event_id", expr(df, ["case", [">", ["get", "value"], 100], "big", ["==", ["get", "event_type"], "click"], "click", "other"]).alias("size"), expr(df, ["match", ["get", "event_type"], "click", "#ff0000", "view", "green", "#888888"]).alias("fill"))


@query("SELECT event_id, CASE WHEN coalesce(value, 0) <= 0 THEN 2e0 WHEN value >= 200 THEN 10e0 ELSE 2e0 + 8e0 * ((value - 0e0) / 200e0) END AS radius FROM events")
def style_interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return df.select("event_id", expr(df, ["interpolate", ["linear"], ["get", "value"], 0, 2, 200, 10]).alias("radius"))


@query("SELECT p_partkey, round(CASE WHEN p_size <= 5 THEN 0e0 WHEN p_size >= 45 THEN 1e0 ELSE (pow(1.5e0, (p_size - 5e0) / 40e0) - 1e0) / 0.5e0 END, 6) AS weight FROM part")
def style_interpolate_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.select("p_partkey", F.round(expr(df, ["interpolate", ["exponential", 1.5], ["get", "p_size"], 5, 0, 45, 1]), 6).alias("weight"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS step FROM part")
def style_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.select("p_partkey", expr(df, ["step", ["get", "p_size"], "small", 10, "middle", 30, "large"]).alias("step"))


@query("SELECT p_partkey, coalesce(p_brand, 'none') || '/' || upper(p_type) || '/' || lower(p_name) || '/' || p_size AS label FROM part")
def style_coalesce_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.select("p_partkey", expr(df, ["concat", ["coalesce", ["get", "nothing"], ["get", "p_brand"], "none"], "/", ["upcase", ["get", "p_type"]], "/", ["downcase", ["get", "p_name"]], "/", ["get", "p_size"]]).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + l_linenumber AS added, l_quantity * l_discount AS times, l_quantity - l_linenumber AS less, CASE WHEN l_discount = 0 THEN 0e0 ELSE l_quantity / l_discount END AS over, CASE WHEN l_linenumber = 0 THEN 0e0 ELSE l_quantity % l_linenumber END AS rest FROM lineitem")
def expr_math_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    q, n, d = ["get", "l_quantity"], ["get", "l_linenumber"], ["get", "l_discount"]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", expr(df, ["+", q, n, ["get", "l_returnflag"]]).alias("added"), expr(df, ["*", q, d]).alias("times"), expr(df, ["-", q, n]).alias("less"), expr(df, ["/", q, d]).alias("over"), expr(df, ["%", q, n]).alias("rest"))


@query("SELECT p_partkey, least(p_size, p_retailprice, 20e0) AS low, greatest(p_size, p_retailprice, 20e0) AS high, round(p_retailprice) AS near, floor(p_retailprice) AS below, ceil(p_retailprice) AS above, abs(p_size - 25e0) AS away FROM part")
def expr_minmax_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    s, r = ["get", "p_size"], ["get", "p_retailprice"]
    return df.select("p_partkey", expr(df, ["min", s, r, 20]).alias("low"), expr(df, ["max", s, r, 20]).alias("high"), expr(df, ["round", r]).alias("near"), expr(df, ["floor", r]).alias("below"), expr(df, ["ceil", r]).alias("above"), expr(df, ["abs", ["-", s, 25]]).alias("away"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS price, o_orderkey::DOUBLE::BIGINT::VARCHAR AS key, (o_custkey % 2 = 0)::VARCHAR AS even FROM orders")
def expr_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    return df.select("o_orderkey", expr(df, ["to-string", ["get", "o_totalprice"]]).alias("price"), expr(df, ["to-string", ["get", "o_orderkey"]]).alias("key"), expr(df, ["to-string", ["==", ["%", ["get", "o_custkey"], 2], 0]]).alias("even"))


@query("SELECT event_id, event_type <> '' AND coalesce(value, 0) <> 0 AS both_true, coalesce(value, 0) = 0 AS not_value, event_type = 'view' OR coalesce(value, 0) > 50 AS either_true, coalesce(try_cast(props AS DOUBLE), 0e0) AS as_number FROM events")
def expr_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return df.select("event_id", expr(df, ["all", ["get", "event_type"], ["get", "value"]]).alias("both_true"), expr(df, ["!", ["get", "value"]]).alias("not_value"), expr(df, ["any", ["==", ["get", "event_type"], "view"], [">", ["get", "value"], 50]]).alias("either_true"), expr(df, ["to-number", ["get", "props"]]).alias("as_number"))


@query("SELECT p_partkey, least(greatest(p_size::DOUBLE, 10e0), 40e0) AS clamped, 1e0 + (p_size - 1e0) * 0.25e0 AS blended, strlen(p_name)::DOUBLE AS bytes, contains(p_type, 'STEEL') AS steel, round(sqrt(p_size::DOUBLE), 9) AS root, round(ln(p_size::DOUBLE), 9) AS natural_log FROM part")
def fn_builtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    s = ["get", "p_size"]
    return df.select("p_partkey", expr(df, ["fn", "clamp", s, 10, 40]).alias("clamped"), expr(df, ["fn", "lerp", 1, s, 0.25]).alias("blended"), expr(df, ["fn", "len", ["get", "p_name"]]).alias("bytes"), expr(df, ["fn", "contains", ["get", "p_type"], "STEEL"]).alias("steel"), F.round(expr(df, ["fn", "sqrt", s]), 9).alias("root"), F.round(expr(df, ["fn", "log", s]), 9).alias("natural_log"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT)::DOUBLE * 2 AS doubled FROM events")
def json_prop_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "double").alias("k"))
    return df.select("event_id", expr(df, ["*", ["get", "k"], 2]).alias("doubled"))


@query("SELECT p_partkey, 'rgba(' || (p_size * 5) || ',' || (p_size * 3) || ',7,255)' AS parsed FROM part")
def color_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").withColumn("css", F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_size") * 5)), 2, "0"), F.lpad(F.lower(F.hex(F.col("p_size") * 3)), 2, "0"), F.lit("07")))
    return df.select("p_partkey", color_text(values.parse_color(F.col("css"))).alias("parsed"))


@query("SELECT p_partkey, 'rgba(' || round(255e0 * p_size / 50e0)::INT || ',' || round(255e0 - 255e0 * p_size / 50e0)::INT || ',0,255)' AS blended FROM part")
def color_lerp_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.select("p_partkey", color_text(classify.ramp_blend([(0, 255, 0), (255, 0, 0)], F.col("p_size") / 50.0)).alias("blended"))


# filters, rules, layers


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS eq, c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL AS neq, c_acctbal < 0 AS lt, c_acctbal > 5000 AS gt, c_acctbal BETWEEN 0 AND 1000 AS mid, c_name LIKE '%7_' AS like_it FROM customer")
def filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer")
    f = FilterBuilder(df)
    return df.select("c_custkey", f.equal("c_mktsegment", "BUILDING").alias("eq"), f.not_equal("c_mktsegment", "BUILDING").alias("neq"), f.less("c_acctbal", 0).alias("lt"), f.greater("c_acctbal", 5000).alias("gt"), f.between("c_acctbal", 0, 1000).alias("mid"), f.like("c_name", "%7_").alias("like_it"))


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 5000) AND NOT c_nationkey BETWEEN 5 AND 10")
def filter_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer")
    tree = {"op": "and", "filters": [{"op": "or", "filters": [{"op": "eq", "property": "c_mktsegment", "value": "BUILDING"}, {"op": "gt", "property": "c_acctbal", "value": 5000}]}, {"op": "not", "filter": {"op": "between", "property": "c_nationkey", "lower": 5, "upper": 10}}]}
    return df.filter(FilterBuilder(df).compile(tree)).select("c_custkey")


@query(f"SELECT fid, x, y FROM {POINTS_SQL} WHERE x BETWEEN -10 AND 60 AND y BETWEEN -20 AND 45")
def filter_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir)
    return df.filter(FilterBuilder(df).bbox(-10, -20, 60, 45, ("x", "y", "x", "y"))).select("fid", "x", "y")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN '#ff0000' WHEN o_orderstatus = 'F' THEN '#00ff00' ELSE '#000000' END AS line_color, CASE WHEN o_totalprice > 200000 THEN 4e0 ELSE 1e0 END AS line_width, CASE WHEN o_totalprice > 200000 THEN 'dear' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'base' END AS color_from FROM orders")
def rules_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    rules = [
        Rule("dear", 10).where([">", ["get", "o_totalprice"], 200000]).color("line_color", "#ff0000").number("line_width", 4),
        Rule("base", 0).color("line_color", "#000000").number("line_width", 1),
        Rule("done", 5).where(["==", ["get", "o_orderstatus"], "F"]).color("line_color", "#00ff00"),
        Rule("far", 20).zooms(12, None).number("line_width", 9),
    ]
    out = cascade(df, rules, 8.0)
    return out.select("o_orderkey", "line_color", "line_width", F.col("sources")["line_color"].alias("color_from"))


STYLE = {
    "name": "events",
    "layers": [
        {"id": "all", "paint": {"circle-color": ["match", ["get", "class"], "click", "#ff0000", "#888888"], "circle-radius": ["interpolate", ["linear"], ["get", "weight"], 0, 2, 200, 10]}},
        {"id": "icons", "layout": {"icon-image": ["get", "class"], "icon-size": 2}, "paint": {"circle-radius": 3}},
    ],
}


@query(f"SELECT fid, 0 AS layer_ord, CASE WHEN class = 'click' THEN 'rgba(255,0,0,255)' ELSE 'rgba(136,136,136,255)' END AS fill, round(CASE WHEN coalesce(weight, 0) <= 0 THEN 2e0 WHEN weight >= 200 THEN 10e0 ELSE 2e0 + 8e0 * weight / 200e0 END, 4) AS radius, NULL::VARCHAR AS icon FROM {POINTS_SQL} UNION ALL SELECT fid, 1, NULL, 3e0, class FROM {POINTS_SQL}")
def layers_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_style(points(spark, sf_dir), parse_style(STYLE))
    return out.select("fid", "layer_ord", F.when(F.col("fill_color").isNotNull(), color_text(F.col("fill_color"))).alias("fill"), F.round("circle_radius", 4).alias("radius"), F.col("icon_image").alias("icon"))


@query(f"SELECT fid, class IN ('click', 'view') AS has_icon, CASE class WHEN 'click' THEN 16 WHEN 'view' THEN 24 END AS icon_px FROM {POINTS_SQL}")
def sprite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sprites = spark.createDataFrame([("click", 16), ("view", 24)], "name string, icon_px int")
    styled = apply_style(points(spark, sf_dir), parse_style({"layers": [STYLE["layers"][1]]}))
    return with_sprites(styled, sprites).select("fid", "has_icon", "icon_px")


# tiles and geometry

TILE_SQL = "floor((x + 180) / 360 * {n})::BIGINT AS tx, floor((1 - asinh(tan(radians(y))) / pi()) / 2 * {n})::BIGINT AS ty"


@query(f"SELECT fid, {TILE_SQL.format(n=4096)} FROM {POINTS_SQL}")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles.tile_of(F.col("x"), F.col("y"), 12)
    return points(spark, sf_dir).select("fid", t["x"].alias("tx"), t["y"].alias("ty"))


@query(f"WITH b AS (SELECT {TILE_SQL.format(n=256)}, weight FROM {POINTS_SQL}) SELECT z::INT AS z, tx // (1 << (8 - z)) AS tx, ty // (1 << (8 - z)) AS ty, count(*) AS n, round(sum(weight), 4) AS total FROM b, range(0, 9) r(z) GROUP BY 1, 2, 3")
def tile_rollup_zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.rollup(points(spark, sf_dir), range(9), weight="weight")
    return out.select("z", F.col("x").alias("tx"), F.col("y").alias("ty"), "n", F.round("total", 4).alias("total"))


@query(f"SELECT fid, tx, ty, round(tx / 64e0 * 360 - 180, 9) AS west, round((tx + 1) / 64e0 * 360 - 180, 9) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 64e0)))), 9) AS south, round(degrees(atan(sinh(pi() * (1 - 2 * ty / 64e0)))), 9) AS north, tx // 2 AS parent_x, ty // 2 AS parent_y FROM (SELECT fid, {TILE_SQL.format(n=64)} FROM {POINTS_SQL})")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("fid", tiles.tile_of(F.col("x"), F.col("y"), 6).alias("t"))
    rows = rows.withColumn("b", tiles.bounds(F.col("t.z"), F.col("t.x"), F.col("t.y"))).withColumn("p", tiles.parent(F.col("t")))
    return rows.select("fid", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), *[F.round(f"b.{c}", 9).alias(c) for c in ("west", "east", "south", "north")], F.col("p.x").alias("parent_x"), F.col("p.y").alias("parent_y"))


@query(f"WITH b AS (SELECT fid, x AS west, y AS south, least(x + 3, 180) AS east, least(y + 2, 85) AS north FROM {POINTS_SQL}) SELECT fid, tx AS tx, ty AS ty FROM (SELECT fid, unnest(range(least(31, floor((west + 180) / 360 * 32)::BIGINT), least(31, floor((east + 180) / 360 * 32)::BIGINT) + 1)) AS tx, south, north FROM b) a, range(0, 32) r(ty) WHERE ty BETWEEN floor((1 - asinh(tan(radians(north))) / pi()) / 2 * 32)::BIGINT AND floor((1 - asinh(tan(radians(south))) / pi()) / 2 * 32)::BIGINT")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = points(spark, sf_dir).select("fid", F.col("x").alias("west"), F.col("y").alias("south"), F.least(F.col("x") + 3, F.lit(180.0)).alias("east"), F.least(F.col("y") + 2, F.lit(85.0)).alias("north"))
    return tiles.cover(boxes, 5).select("fid", F.col("x").alias("tx"), F.col("y").alias("ty"))


@query(f"SELECT fid, tx, ty FROM (SELECT fid, {TILE_SQL.format(n=8)} FROM {POINTS_SQL}) WHERE (tx, ty) IN ((1, 2), (4, 3), (6, 6))")
def tile_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.createDataFrame([(3, 1, 2), (3, 4, 3), (3, 6, 6)], "z int, x long, y long")
    return tiles.features_in_tiles(points(spark, sf_dir), chosen).select("fid", F.col("x").alias("tx"), F.col("y").alias("ty"))


@query("SELECT o_orderkey AS fid, ((1 + o_custkey % 7) * (1 + o_orderkey % 5))::DOUBLE AS area, (2 * (1 + o_custkey % 7) + 2 * (1 + o_orderkey % 5))::DOUBLE AS perimeter, round((1 + o_custkey % 7) / 2e0, 9) AS cx, round((1 + o_orderkey % 5) / 2e0, 9) AS cy, (1 + o_custkey % 7)::DOUBLE AS max_x, (1 + o_orderkey % 5)::DOUBLE AS max_y FROM orders")
def geom_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.measures(rings(spark, sf_dir), "geom").withColumn("e", geometry.envelope(F.col("geom")))
    return rows.select("fid", "area", F.col("length").alias("perimeter"), F.round("centroid.x", 9).alias("cx"), F.round("centroid.y", 9).alias("cy"), F.col("e.max_x").alias("max_x"), F.col("e.max_y").alias("max_y"))


@query("SELECT o_orderkey AS fid, 'POLYGON ((0 0, ' || w || ' 0, ' || w || ' ' || h || ', 0 ' || h || ', 0 0))' AS wkt, TRUE AS same FROM (SELECT o_orderkey, 1 + o_custkey % 7 AS w, 1 + o_orderkey % 5 AS h FROM orders)")
def wkt_wkb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rings(spark, sf_dir).withColumn("wkb", geometry.to_wkb(F.col("geom")))
    rows = rows.withColumn("wkt", geometry.to_wkt(F.col("geom"))).withColumn("again", geometry.to_wkb(geometry.from_wkb(F.col("wkb"))))
    parsed = geometry.from_wkt(F.col("wkt")).eqNullSafe(F.col("geom"))
    return rows.select("fid", "wkt", (parsed & (F.col("again") == F.col("wkb"))).alias("same"))


# classification


def _classes(df: DataFrame, column: str, breaks: list[float]) -> DataFrame:
    return df.groupBy(classify.classify(F.col(column), breaks).alias("class")).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem) SELECT ((l_extendedprice >= a + (b - a) / 5 * 1)::INT + (l_extendedprice >= a + (b - a) / 5 * 2)::INT + (l_extendedprice >= a + (b - a) / 5 * 3)::INT + (l_extendedprice >= a + (b - a) / 5 * 4)::INT)::INT AS class, count(*) AS n FROM lineitem, m GROUP BY 1")
def class_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return _classes(df, "l_extendedprice", classify.equal_interval(df, "l_extendedprice", 5))


@query("WITH s AS (SELECT list_sort(list(l_extendedprice)) AS v FROM lineitem), b AS (SELECT unnest([v[least(i * len(v) // 4, len(v) - 1) + 1] for i in [1, 2, 3]]) AS q FROM s), c AS (SELECT l_extendedprice, (SELECT count(*) FROM b WHERE q <= l_extendedprice)::INT AS class FROM lineitem) SELECT class, count(*) AS n FROM c GROUP BY 1")
def class_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return _classes(df, "l_extendedprice", classify.quantile(df, "l_extendedprice", 4))


@query("WITH m AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS s FROM part) SELECT ((p_retailprice >= a - 2 * s)::INT + (p_retailprice >= a - s)::INT + (p_retailprice >= a)::INT + (p_retailprice >= a + s)::INT + (p_retailprice >= a + 2 * s)::INT)::INT AS class, count(*) AS n FROM part, m GROUP BY 1")
def class_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return _classes(df, "p_retailprice", classify.standard_deviation(df, "p_retailprice", 2.0))


@query("SELECT (CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END)::INT AS class, count(*) AS n FROM part GROUP BY 1")
def class_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(read(spark, sf_dir, "part"), "p_size", classify.manual([40, 10, 20]))


@query()
def class_jenks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return _classes(df, "p_size", classify.natural_breaks(df, "p_size", 4))


@query()
def class_jenks_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all prices; SQL can't run the programme on so many values, tests compare it on few."""
    df = read(spark, sf_dir, "lineitem")
    breaks = classify.natural_breaks(df, "l_extendedprice", 4)
    rows = df.select(classify.classify(F.col("l_extendedprice"), breaks).alias("class"), "l_extendedprice")
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("SELECT p_partkey, round(3e0 + pow(least(1e0, greatest(0e0, (p_size - 1e0) / 49e0)), 0.5716e0) * 17e0, 6) AS flannery, 3e0 + least(1e0, greatest(0e0, (p_size - 1e0) / 49e0)) * 17e0 AS linear FROM part")
def prop_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.select("p_partkey", F.round(classify.proportional_radius(F.col("p_size"), 1, 50, 3, 20, True), 6).alias("flannery"), classify.proportional_radius(F.col("p_size"), 1, 50, 3, 20).alias("linear"))


# clusters and density


@query(f"WITH c AS (SELECT floor(x / 20)::BIGINT AS cx, floor(y / 20)::BIGINT AS cy, count(*) AS count, avg(x) AS x, avg(y) AS y FROM {POINTS_SQL} GROUP BY 1, 2) SELECT cx, cy, count, round(c.x, 8) AS x, round(c.y, 8) AS y FROM c WHERE count >= 3 UNION ALL SELECT cx, cy, 1, round(p.x, 8), round(p.y, 8) FROM {POINTS_SQL} p JOIN c ON floor(p.x / 20) = cx AND floor(p.y / 20) = cy WHERE count < 3")
def cluster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.grid_clusters(points(spark, sf_dir), 10.0, 3, members=False)
    return out.select("cx", "cy", "count", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query(f"WITH g AS (SELECT z, floor(x / (80e0 / (1 << z)))::BIGINT AS cx, floor(y / (80e0 / (1 << z)))::BIGINT AS cy, x, y FROM {POINTS_SQL}, range(0, 6) r(z)), c AS (SELECT z, cx, cy, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM g GROUP BY 1, 2, 3) SELECT z::INT AS z, count(*) AS clusters, sum(n)::BIGINT AS members, round(sum(mx), 6) AS sum_x FROM (SELECT z, n, mx FROM c WHERE n >= 2 UNION ALL SELECT z, n, mx FROM c WHERE n < 2) GROUP BY 1")
def cluster_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.hierarchical_clusters(points(spark, sf_dir), 0, 5, 40.0)
    return out.groupBy("z").agg(F.count("*").alias("clusters"), F.sum("count").alias("members"), F.round(F.sum("x"), 6).alias("sum_x"))


@query()
def cluster_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(points(spark, sf_dir), 2.0, 4)


_DENSITY_SQL = f"WITH p AS (SELECT (x + 180) * (128 / 360e0) AS sx, (85 - y) * (64 / 170e0) AS sy, weight AS w FROM {POINTS_SQL}), c AS (SELECT px::INT AS px, py::INT AS py, sum(w * exp(-((px - sx) * (px - sx) + (py - sy) * (py - sy)) / (2 * (4 / 3e0) * (4 / 3e0)))) AS d FROM p, range(0, 128) a(px), range(0, 64) b(py) WHERE px BETWEEN sx - 4 AND sx + 4 AND py BETWEEN sy - 4 AND sy + 4 AND (px - sx) * (px - sx) + (py - sy) * (py - sy) <= 16 GROUP BY 1, 2)"


@query(_DENSITY_SQL + " SELECT px, py, round(d, 4) AS density, round(d / (SELECT max(d) FROM c), 6) AS t FROM c")
def heatmap_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = density.kernel_density(points(spark, sf_dir), (-180, -85, 180, 85), 128, 64, radius=4.0, weight="weight")
    return d.join(density.heatmap(d).select("px", "py", "t"), ["px", "py"]).select("px", "py", F.round("density", 4).alias("density"), F.round("t", 6).alias("t"))


# time


@query(f"WITH m AS (SELECT max(t) AS now FROM {POINTS_SQL}) SELECT fid, round(1 - (now - t) / 86400e0, 9) AS opacity FROM {POINTS_SQL}, m WHERE t BETWEEN now - 86400 AND now")
def time_window_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir)
    now = df.agg(F.max("t")).first()[0]
    return temporal.time_window(df, now, 86400.0, fade=True).select("fid", F.round("opacity", 9).alias("opacity"))


@query(f"WITH m AS (SELECT min(t) AS a, max(t) AS b FROM {POINTS_SQL}), f AS (SELECT i AS frame, a + i * ((b - a) / 11) AS frame_t FROM m, range(0, 12) r(i)) SELECT frame, count(*) AS n FROM f JOIN {POINTS_SQL} p ON p.t BETWEEN f.frame_t - 43200 AND f.frame_t GROUP BY 1")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir)
    a, b = df.agg(F.min("t"), F.max("t")).first()
    return temporal.keyframes(df, a, b, 12, 43200.0).groupBy("frame").agg(F.count("*").alias("n"))


@query(f"WITH m AS (SELECT min(t) + (max(t) - min(t)) / 2 AS moment FROM {POINTS_SQL}), s AS (SELECT entity, t AS t0, x AS x0, y AS y0, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS i FROM {POINTS_SQL} WINDOW w AS (PARTITION BY entity ORDER BY t)) SELECT entity, round(CASE WHEN (i = 1 AND moment <= t0) OR t1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * ((moment - t0) / (t1 - t0)) END, 6) AS x, round(CASE WHEN (i = 1 AND moment <= t0) OR t1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * ((moment - t0) / (t1 - t0)) END, 6) AS y FROM s, m WHERE (i = 1 AND moment <= t0) OR (moment > t0 AND (moment <= t1 OR t1 IS NULL))")
def trajectory_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir)
    a, b = df.agg(F.min("t"), F.max("t")).first()
    return temporal.trajectory_at(df, [a + (b - a) / 2]).select("entity", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT p_partkey, round(t * t, 9) AS ease_in, round(t * (2 - t), 9) AS ease_out, round(CASE WHEN t < 0.5 THEN 2 * t * t ELSE 1 - (2 - 2 * t) * (2 - 2 * t) / 2 END, 9) AS ease_both FROM (SELECT p_partkey, p_size / 50e0 AS t FROM part)")
def easing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartolake.functions.easing import ease

    t = F.col("p_size") / 50.0
    return read(spark, sf_dir, "part").select("p_partkey", F.round(ease(t, "in"), 9).alias("ease_in"), F.round(ease(t, "out"), 9).alias("ease_out"), F.round(ease(t, "in-out"), 9).alias("ease_both"))


# terrain and symbols

#: Heights of a grid 50 cells wide, one cell an order.
_DEM_SQL = "(SELECT (o_orderkey // 50)::INT AS r, (o_orderkey % 50)::INT AS c, (o_custkey % 50)::DOUBLE AS e FROM orders)"


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.floor(i / 50).cast("int").alias("row"), (i % 50).cast("int").alias("col"), (F.col("o_custkey") % 50).cast("double").alias("elev"))


HILLSHADE_SQL = f"WITH d AS {_DEM_SQL}, n AS (SELECT r, c, e, lag(e) OVER w AS w1, lead(e) OVER w AS e1 FROM d WINDOW w AS (PARTITION BY r ORDER BY c)), g AS (SELECT r, c, ((u.e1 + 2 * m.e1 + l.e1) - (u.w1 + 2 * m.w1 + l.w1)) / 80e0 AS dx, ((l.w1 + 2 * l.e + l.e1) - (u.w1 + 2 * u.e + u.e1)) / 80e0 AS dy FROM n m JOIN n u USING (c) JOIN n l USING (c, r) WHERE FALSE) SELECT m.r AS \"row\", m.c AS col, (CASE WHEN m.r IN (0, (SELECT max(r) FROM d)) OR m.c IN (0, 49) THEN 128 ELSE greatest(0, least(255, floor(255 * (cos(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + sin(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135) - CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE atan2(dy, -dx) END)))))  END)::INT AS shade FROM (SELECT m.r, m.c, ((u.e1 + 2 * m.e1 + l.e1) - (u.w1 + 2 * m.w1 + l.w1)) / 80e0 AS dx, ((l.w1 + 2 * l.e + l.e1) - (u.w1 + 2 * u.e + u.e1)) / 80e0 AS dy FROM n m LEFT JOIN n u ON u.r = m.r - 1 AND u.c = m.c LEFT JOIN n l ON l.r = m.r + 1 AND l.c = m.c) m"


@query(HILLSHADE_SQL)
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").count() // 50
    return terrain.hillshade(dem(spark, sf_dir), 50, rows, cell=10.0)


HYPSOMETRIC_SQL = f"WITH t AS (SELECT r, c, e, least(1, greatest(0, e / 49e0)) AS t FROM {_DEM_SQL}), q AS (SELECT *, least(3, floor(t * 4))::INT AS q FROM t), s AS (SELECT *, (t - q * 0.25) * 4 AS s FROM q) SELECT r AS \"row\", c AS col, 'rgba(' || floor(CASE q WHEN 0 THEN 40 + 150 * s WHEN 1 THEN 190 + 50 * s WHEN 2 THEN 240 - 40 * s ELSE 200 + 55 * s END)::INT || ',' || floor(CASE q WHEN 0 THEN 140 + 70 * s WHEN 1 THEN 210 - 60 * s WHEN 2 THEN 150 - 50 * s ELSE 100 + 155 * s END)::INT || ',' || floor(CASE q WHEN 0 THEN 40 + 20 * s WHEN 1 THEN 60 + 20 * s WHEN 2 THEN 80 + 50 * s ELSE 130 + 125 * s END)::INT || ',255)' AS color, CASE WHEN abs(e % 25) < 0.01 THEN 'index' ELSE 'intermediate' END AS contour FROM s"


@query(HYPSOMETRIC_SQL)
def hypsometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return d.select("row", "col", color_text(terrain.hypsometric(F.col("elev"), 0, 49)).alias("color"), terrain.contour_class(F.col("elev"), 25.0).alias("contour"))


OVERLAY_SQL = f"""
WITH shade AS ({HILLSHADE_SQL}), tint AS (SELECT "row", col, string_split(replace(replace(color, 'rgba(', ''), ')', ''), ',')::INT[] AS p FROM ({HYPSOMETRIC_SQL}))
SELECT "row", col, 'rgba(' || array_to_string(list_transform(p[1:3], lambda v: floor(v * (1 - (1 - shade / 255e0) * 0.5e0))::INT), ',') || ',' || p[4] || ')' AS color FROM shade JOIN tint USING ("row", col)
"""


@query(OVERLAY_SQL)
def hillshade_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation colours under half of the shade of their slopes."""
    tint = dem(spark, sf_dir).withColumn("tint", terrain.hypsometric(F.col("elev"), 0, 49))
    return tint.join(hillshade(spark, sf_dir), ["row", "col"]).select("row", "col", color_text(terrain.shaded(F.col("tint"), F.col("shade"), 0.5)).alias("color"))


CONTOUR_SQL = f"""
WITH d AS {_DEM_SQL}, cell AS (
  SELECT a.r, a.c, a.e AS e0, b.e AS e1, x.e AS e2, y.e AS e3
  FROM d a JOIN d b ON b.r = a.r AND b.c = a.c + 1 JOIN d x ON x.r = a.r + 1 AND x.c = a.c JOIN d y ON y.r = a.r + 1 AND y.c = a.c + 1
), corner AS (
  SELECT r, c, [{{'x': c::DOUBLE, 'y': r::DOUBLE, 'e': e0}}, {{'x': c + 1e0, 'y': r::DOUBLE, 'e': e1}}, {{'x': c::DOUBLE, 'y': r + 1e0, 'e': e2}}] AS t FROM cell
  UNION ALL SELECT r, c, [{{'x': c + 1e0, 'y': r + 1e0, 'e': e3}}, {{'x': c::DOUBLE, 'y': r + 1e0, 'e': e2}}, {{'x': c + 1e0, 'y': r::DOUBLE, 'e': e1}}] FROM cell
), high AS (
  SELECT *, unnest(range(ceil(least(t[1].e, t[2].e, t[3].e) / 10)::BIGINT, floor(greatest(t[1].e, t[2].e, t[3].e) / 10)::BIGINT + 1)) * 10e0 AS level FROM corner
), hit AS (
  SELECT r, c, level, list_filter(list_transform([(1, 2), (2, 3), (3, 1)], lambda k:
           CASE WHEN (t[k[1]].e < level) <> (t[k[2]].e < level) THEN {{'x': t[k[1]].x + (t[k[2]].x - t[k[1]].x) * ((level - t[k[1]].e) / (t[k[2]].e - t[k[1]].e)),
                                                                      'y': t[k[1]].y + (t[k[2]].y - t[k[1]].y) * ((level - t[k[1]].e) / (t[k[2]].e - t[k[1]].e))}} END), lambda h: h IS NOT NULL) AS h
  FROM high
)
SELECT r AS "row", c AS col, level, CASE WHEN abs(level % 50) < 0.01 THEN 'index' ELSE 'intermediate' END AS kind,
       h[1].x AS x1, h[1].y AS y1, h[2].x AS x2, h[2].y AS y2
FROM hit WHERE len(h) = 2
"""


@query(CONTOUR_SQL)
def contour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.contour_lines(dem(spark, sf_dir))


#: Pieces from edge to edge, then pointers that double twenty times; a line's pieces share its end, or on a ring its least edge.
POLYLINE_SQL = CONTOUR_SQL[: CONTOUR_SQL.index("), hit AS (")].replace("WITH d AS", "WITH RECURSIVE d AS") + """), side AS (
  SELECT level, unnest(list_transform([(1, 2), (2, 3), (3, 1)], lambda k: {
           'k': ((least(t[k[1]].y, t[k[2]].y)::BIGINT * 2147483648 + least(t[k[1]].x, t[k[2]].x)::BIGINT) * 4 + CASE WHEN t[k[1]].y = t[k[2]].y THEN 0 WHEN t[k[1]].x = t[k[2]].x THEN 1 ELSE 2 END)::BIGINT,
           'from': t[k[1]].e >= level, 'to': t[k[2]].e >= level,
           'x': t[k[1]].x + (t[k[2]].x - t[k[1]].x) * ((level - t[k[1]].e) / CASE WHEN t[k[1]].e = t[k[2]].e THEN 1 ELSE t[k[2]].e - t[k[1]].e END),
           'y': t[k[1]].y + (t[k[2]].y - t[k[1]].y) * ((level - t[k[1]].e) / CASE WHEN t[k[1]].e = t[k[2]].e THEN 1 ELSE t[k[2]].e - t[k[1]].e END)})) AS k, n
  FROM (SELECT *, row_number() OVER () AS n FROM high)
), piece AS (
  SELECT f.level, f.k.k AS s, u.k.k AS e, sqrt((f.k.x - u.k.x) * (f.k.x - u.k.x) + (f.k.y - u.k.y) * (f.k.y - u.k.y)) AS size
  FROM side f JOIN side u USING (n) WHERE f.k.from AND NOT f.k.to AND u.k.to AND NOT u.k.from
), jump AS (
  SELECT 0 AS i, level, s, e, s AS least FROM piece
  UNION ALL SELECT a.i + 1, a.level, a.s, coalesce(b.e, a.e), least(a.least, coalesce(b.least, a.least)) FROM jump a LEFT JOIN jump b ON a.level = b.level AND a.e = b.s WHERE a.i < 20
), last AS (
  SELECT level, s, CASE WHEN e IN (SELECT s FROM piece p WHERE p.level = j.level) THEN least ELSE e END AS line, e IN (SELECT s FROM piece p WHERE p.level = j.level) AS closed FROM jump j WHERE i = 20
)
SELECT line, level, CASE WHEN abs(level % 50) < 0.01 THEN 'index' ELSE 'intermediate' END AS kind, closed, count(*) + 1 AS n_points, round(sum(size), 6) AS length
FROM last JOIN piece USING (level, s) GROUP BY ALL
"""


@query(POLYLINE_SQL)
def contour_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contour line once, with its points and its length along them."""
    lines = terrain.contour_polylines(dem(spark, sf_dir))
    a, b = lambda i: F.get("pts", i), lambda i: F.get("pts", i + 1)
    steps = F.transform(F.sequence(F.lit(0), F.size("pts") - 2), lambda i: F.sqrt((a(i)["x"] - b(i)["x"]) * (a(i)["x"] - b(i)["x"]) + (a(i)["y"] - b(i)["y"]) * (a(i)["y"] - b(i)["y"])))
    return lines.select("line", "level", "kind", "closed", F.size("pts").cast("long").alias("n_points"), F.round(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), 6).alias("length"))


@query("SELECT p_partkey, CASE WHEN d < 0 THEN 'DEPIT' WHEN d < 5 THEN 'DEPVS' WHEN d < 30 THEN 'DEPMD' ELSE 'DEPDW' END AS token, CASE WHEN d < 0 THEN 'rgba(93,133,120,255)' WHEN d < 5 THEN 'rgba(120,153,153,255)' WHEN d < 30 THEN 'rgba(133,150,163,255)' ELSE 'rgba(120,140,160,255)' END AS dusk, d < 30 AS danger FROM (SELECT p_partkey, p_size - 5e0 AS d FROM part)")
def depth_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("p_size") - 5.0
    rows = read(spark, sf_dir, "part").withColumn("token", symbology.depth_token(d))
    return rows.select("p_partkey", "token", color_text(symbology.chart_color(F.col("token"), "dusk")).alias("dusk"), (symbology.sounding_color(d)["r"] == 255).alias("danger"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Friend' WHEN c_custkey % 3 = 1 THEN 'Hostile' ELSE 'Unknown' END AS affiliation, CASE WHEN c_nationkey % 2 = 0 THEN 'Air' ELSE 'Ground' END AS dimension, CASE WHEN c_custkey % 3 = 0 THEN 'Rectangle' WHEN c_custkey % 3 = 1 THEN 'Diamond' WHEN c_nationkey % 2 = 0 THEN 'Arc' ELSE 'Circle' END AS shape, 'Company' AS echelon, TRUE AS headquarters, lpad(c_custkey::VARCHAR, 9, '0') AS entity_code FROM customer")
def sidc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.concat(F.lit("S"), F.when(k % 3 == 0, "F").when(k % 3 == 1, "6").otherwise("Z"), F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("G"), F.lit("PAE"), F.lpad(k.cast("string"), 9, "0"))
    rows = read(spark, sf_dir, "customer").withColumn("s", symbology.parse_sidc(code))
    return rows.select("c_custkey", "s.affiliation", "s.dimension", symbology.frame_shape(F.col("s")).alias("shape"), "s.echelon", "s.headquarters", "s.entity_code")


# pixels, labels, pages, sources


def _screen(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    df = points(spark, sf_dir)
    fill = F.when(F.col("class") == "click", values.color(255, 0, 0)).otherwise(values.color(0, 0, 255))
    return df.select(F.lit("all").alias("canvas"), F.lit(0).alias("layer_ord"), "fid", ((F.col("x") + 180) * (256 / 360.0)).alias("x"), ((F.lit(85.0) - F.col("y")) * (256 / 170.0)).alias("y"), F.lit(1.0).alias("radius"), fill.alias("rgba"), *more)


@query(f"WITH p AS (SELECT fid, trunc((x + 180) * (256 / 360e0))::INT AS cx, trunc((85 - y) * (256 / 170e0))::INT AS cy, class FROM {POINTS_SQL}), d AS (SELECT fid, cx + a AS px, cy + b AS py, class FROM p, range(-1, 2) s(a), range(-1, 2) t(b) WHERE a * a + b * b <= 1) SELECT px::INT AS px, py::INT AS py, arg_max(CASE WHEN class = 'click' THEN 'rgba(255,0,0,255)' ELSE 'rgba(0,0,255,255)' END, fid) AS color FROM d WHERE px BETWEEN 0 AND 255 AND py BETWEEN 0 AND 255 GROUP BY 1, 2")
def sparse_points_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.overwrite(raster.discs(_screen(spark, sf_dir), 256, 256))
    return out.select("px", "py", color_text(F.col("rgba")).alias("color"))


def _over_sql(c: str, s: str = "s", t: str = "t") -> str:
    """Channel c of colour t over s, or the alpha of both."""
    a, b = f"({t}.a / 255e0)", f"({s}.a / 255e0)"
    out = f"({a} + {b} * (1e0 - {a}))"
    if c == "a":
        return f"trunc({out} * 255e0)::INT"
    return f"CASE WHEN {out} > 0 THEN trunc(({t}.{c} / 255e0 * {a} + {s}.{c} / 255e0 * {b} * (1e0 - {a})) / {out} * 255e0)::INT ELSE 0 END"


def _fold_sql(stack: str) -> str:
    colour = ", ".join(f"'{c}': {_over_sql(c)}" for c in "rgba")
    return f"list_reduce({stack}, lambda s, t: {{{colour}}}, {{'r': 0, 'g': 0, 'b': 0, 'a': 0}})"


BLEND_SQL = f"""
WITH p AS (
  SELECT fid, class, (x + 180) * (256 / 360e0) AS x, (85e0 - y) * (256 / 170e0) AS y FROM {POINTS_SQL}
), d AS (
  SELECT *, unnest(range(greatest(0, floor(y - 4.5e0)::INT), least(255, ceil(y + 4.5e0)::INT) + 1))::INT AS py FROM p
), e AS (
  SELECT *, unnest(range(greatest(0, floor(x - 4.5e0)::INT), least(255, ceil(x + 4.5e0)::INT) + 1))::INT AS px FROM d
), c AS (
  SELECT *, least(1e0, 4e0 - sqrt((px + 0.5e0 - x) * (px + 0.5e0 - x) + (py + 0.5e0 - y) * (py + 0.5e0 - y))) AS cover FROM e
), s AS (
  SELECT px, py, {_fold_sql("list({'r': CASE WHEN class = 'click' THEN 255 ELSE 0 END, 'g': 0, 'b': CASE WHEN class = 'click' THEN 0 ELSE 255 END, 'a': trunc(127 * cover)::INT} ORDER BY fid)")} AS k
  FROM c WHERE cover > 0 GROUP BY px, py
)
SELECT px, py, 'rgba(' || k.r || ',' || k.g || ',' || k.b || ',' || k.a || ')' AS color FROM s
"""


@query(BLEND_SQL)
def blended_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _screen(spark, sf_dir).withColumns({"radius": F.lit(3.5), "rgba": raster.faded(F.col("rgba"), F.lit(0.5))})
    return raster.blend(raster.discs(rows, 256, 256, smooth=True)).select("px", "py", color_text(F.col("rgba")).alias("color"))


@query("SELECT (w * h)::BIGINT AS n, count(*) AS polygons FROM (SELECT (1 + o_custkey % 7) * 4 AS w, (1 + o_orderkey % 5) * 4 AS h FROM orders) GROUP BY 1")
def polygon_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each rectangle at four pixels a unit: as many as its area."""
    scaled = F.transform(geometry.vertices(F.col("geom")), lambda p: F.struct((p["x"] * 4).alias("x"), (p["y"] * 4).alias("y")))
    rows = rings(spark, sf_dir).select(F.lit("a").alias("canvas"), F.lit(0).alias("layer_ord"), "fid", F.array(scaled).alias("rings"), values.color(1, 2, 3).alias("rgba"))
    counts = raster.fills(rows, 64, 64).groupBy("fid").agg(F.count("*").alias("n"))
    return counts.groupBy("n").agg(F.count("*").alias("polygons"))


#: Each size of rectangle once: its dashes of 4 on and 2 off, the pixels within 1 of a dash, then how many outlines lie on each pixel.
STROKE_SQL = f"""
WITH o AS (
  SELECT 'c' || (o_orderkey % 8) AS canvas, (1 + o_custkey % 7) * 4e0 AS w, (1 + o_orderkey % 5) * 4e0 AS h FROM orders
), side AS (
  SELECT w, h, unnest([{{'x': 4e0, 'y': 4e0, 'dx': 1, 'dy': 0, 'at': 0e0, 'len': w}}, {{'x': 4 + w, 'y': 4e0, 'dx': 0, 'dy': 1, 'at': w, 'len': h}},
                       {{'x': 4 + w, 'y': 4 + h, 'dx': -1, 'dy': 0, 'at': w + h, 'len': w}}, {{'x': 4e0, 'y': 4 + h, 'dx': 0, 'dy': -1, 'at': 2 * w + h, 'len': h}}]) AS s
  FROM (SELECT DISTINCT w, h FROM o)
), dash AS (
  SELECT w, h, s, greatest(s.at, 6 * k) - s.at AS a, least(s.at + s.len, 6 * k + 4) - s.at AS b FROM side, range(0, 20) r(k)
), hit AS (
  SELECT DISTINCT w, h, px, py
  FROM (SELECT *, s.x + s.dx * least(b, greatest(a, (px + 0.5e0 - s.x) * s.dx + (py + 0.5e0 - s.y) * s.dy)) AS nx,
                  s.y + s.dy * least(b, greatest(a, (px + 0.5e0 - s.x) * s.dx + (py + 0.5e0 - s.y) * s.dy)) AS ny
        FROM dash, range(0, 64) i(px), range(0, 64) j(py) WHERE a < b)
  WHERE (px + 0.5e0 - nx) * (px + 0.5e0 - nx) + (py + 0.5e0 - ny) * (py + 0.5e0 - ny) <= 1
), n AS (
  SELECT canvas, px::INT AS px, py::INT AS py, count(*)::INT AS n FROM o JOIN hit USING (w, h) GROUP BY ALL
), k AS (
  SELECT n, {_fold_sql("list_transform(range(n), lambda i: {'r': 0, 'g': 0, 'b': 0, 'a': 128})")} AS k FROM (SELECT DISTINCT n FROM n)
)
SELECT canvas, px, py, 'rgba(0,0,0,' || k.a || ')' AS color FROM n JOIN k USING (n)
"""


@query(STROKE_SQL)
def line_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rings(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("fid") % 8).cast("string")).alias("canvas"), F.lit(0).alias("layer_ord"), "fid", F.transform(geometry.vertices(F.col("geom")), lambda p: F.struct((p["x"] * 4 + 4).alias("x"), (p["y"] * 4 + 4).alias("y"))).alias("pts"), F.lit(2.0).alias("line_width"), values.color(0, 0, 0, 128).alias("rgba"))
    return raster.blended_strokes(rows, 64, 64, "round", dashes=[4, 2]).select("canvas", "px", "py", color_text(F.col("rgba")).alias("color"))


#: Every pixel near an anchor tried against every icon's box; icons of 6 x 4 pixels, turned by 0 or 90 degrees.
ICON_SQL = f"""
WITH p AS (
  SELECT fid, class, (x + 180) * (256 / 360e0) + (fid % 3) AS x, (85e0 - y) * (256 / 170e0) - 1 AS y, CASE fid % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1e0 WHEN 2 THEN 1.5e0 ELSE 2e0 END AS s, fid % 5 = 0 AS turned FROM {POINTS_SQL}
), b AS (
  SELECT *, trunc(6 * s) AS w, trunc(4 * s) AS h, trunc(x) - floor(trunc(6 * s) / 2) AS x0, trunc(y) - floor(trunc(4 * s) / 2) AS y0, cos(radians(90)) AS c, sin(radians(90)) AS n FROM p
), t AS (
  SELECT *, trunc(x)::INT + i AS px, trunc(y)::INT + j AS py FROM b, range(-9, 10) g(i), range(-9, 10) k(j)
), l AS (
  SELECT *, CASE WHEN turned THEN x + (px + 0.5e0 - x) * c + (py + 0.5e0 - y) * n - x0 ELSE px - x0 END AS lx, CASE WHEN turned THEN y - (px + 0.5e0 - x) * n + (py + 0.5e0 - y) * c - y0 ELSE py - y0 END AS ly
  FROM t WHERE px BETWEEN 0 AND 255 AND py BETWEEN 0 AND 255
)
SELECT px::INT AS px, py::INT AS py, arg_max('rgba(' || (least(5, floor(lx / s)) * 40)::INT || ',' || (least(3, floor(ly / s)) * 60)::INT || ',' || length(class) * 9 || ',200)', fid) AS color
FROM l WHERE lx >= 0 AND ly >= 0 AND lx < w AND ly < h GROUP BY ALL
"""


@query(ICON_SQL)
def icon_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An icon for each class of event, drawn at four scales, every fifth turned by 90 degrees."""
    k = F.col("fid")
    classes = points(spark, sf_dir).select(F.col("class").alias("icon")).distinct()
    atlas = classes.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(3))))
    atlas = atlas.withColumn("rgba", values.color(F.col("u") * 40, F.col("v") * 60, F.length("icon") * 9, 200))
    scale = F.element_at(F.array(*[F.lit(v) for v in (0.5, 1.0, 1.5, 2.0)]), (k % 4 + 1).cast("int"))
    placed = _screen(spark, sf_dir, F.col("class").alias("icon")).withColumns({"scale": scale, "rotation": F.when(k % 5 == 0, 90.0).otherwise(0.0), "dx": (k % 3).cast("double"), "dy": F.lit(-1.0)})
    return raster.overwrite(raster.icons(placed, atlas, 256, 256)).select("px", "py", color_text(F.col("rgba")).alias("color"))


LABEL_SQL = f"""
WITH RECURSIVE l AS (
  SELECT *, row_number() OVER (PARTITION BY canvas ORDER BY priority DESC, fid) AS k
  FROM (SELECT tx || '/' || ty AS canvas, fid, class AS text, (fid * 37 % 240)::DOUBLE AS x, (fid * 91 % 240)::DOUBLE AS y,
               (length(class) * 6)::DOUBLE AS width, 8e0 AS height, (fid % 5)::INT AS priority
        FROM (SELECT fid, class, {TILE_SQL.format(n=16)} FROM {POINTS_SQL}))
), step AS (
  SELECT DISTINCT canvas, 0::BIGINT AS k, NULL::BIGINT AS fid, []::STRUCT(x DOUBLE, y DOUBLE, r DOUBLE, b DOUBLE)[] AS taken, NULL::STRUCT(x DOUBLE, y DOUBLE, r DOUBLE, b DOUBLE) AS spot FROM l
  UNION ALL
  SELECT canvas, k, fid, CASE WHEN spot IS NULL THEN taken ELSE list_append(taken, spot) END, spot
  FROM (SELECT l.canvas, l.k, l.fid, s.taken, list_filter(
          list_transform([(0, 0), (1, 0), (-1, 0), (0, -1), (0, 1), (1, -1), (-1, -1), (1, 1), (-1, 1)],
            lambda m: {{'x': l.x + m[1] * (l.width + 4) - 2, 'y': l.y + m[2] * (l.height + 4) - 2, 'r': l.x + m[1] * (l.width + 4) + l.width + 2, 'b': l.y + m[2] * (l.height + 4) + l.height + 2}}),
          lambda c: c.x >= -2 AND c.y >= -2 AND c.r <= 258 AND c.b <= 258
            AND len(list_filter(s.taken, lambda t: c.x < t.r AND c.r > t.x AND c.y < t.b AND c.b > t.y)) = 0)[1] AS spot
        FROM step s JOIN l ON l.canvas = s.canvas AND l.k = s.k + 1)
)
SELECT l.canvas, l.fid, l.text, spot.x + 2 AS x, spot.y + 2 AS y, l.width, l.height, l.priority FROM step JOIN l USING (canvas, k) WHERE spot IS NOT NULL
"""


@query(LABEL_SQL)
def label_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles.tile_of(F.col("x"), F.col("y"), 4)
    rows = points(spark, sf_dir).select(F.concat_ws("/", t["x"], t["y"]).alias("canvas"), "fid", F.col("class").alias("text"), (F.col("fid") * 37 % 240).alias("x"), (F.col("fid") * 91 % 240).alias("y"), (F.length("class") * 6).alias("width"), F.lit(8).alias("height"), (F.col("fid") % 5).alias("priority"))
    return labels.place_labels(rows, 256, 256)


@query("SELECT fid, '<circle cx=\"' || printf('%.2f', x) || '\" cy=\"' || printf('%.2f', y) || '\" r=\"2.00\" fill=\"#123456\"/>' AS element FROM (SELECT event_id AS fid, (event_id % 100)::DOUBLE AS x, (event_id % 77)::DOUBLE AS y FROM events)")
def svg_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("fid"), (F.col("event_id") % 100).cast("double").alias("x"), (F.col("event_id") % 77).cast("double").alias("y"))
    return rows.select("fid", svg.circle(F.col("x"), F.col("y"), F.lit(2.0), F.lit("#123456")).alias("element"))


def _tile_bytes(layer: str, x: int, y: int, name: str) -> bytes:
    """One point with one property, encoded by hand."""
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    zig = lambda n: (n << 1) ^ (n >> 31)

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    feature = field(2, b"\x00\x00") + b"\x18\x01" + field(4, b"\x09" + varint(zig(x)) + varint(zig(y)))
    return field(3, field(1, layer.encode()) + field(2, feature) + field(3, b"name") + field(4, field(1, name.encode())) + b"\x28\x80\x20")


def _event_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        tiles_ = [_tile_bytes("places", i * 37 % 4096, i * 91 % 4096, kind) if i % 10 != 3 else b"\x1a\xff\x00" for i, kind in zip(b["event_id"], b["event_type"], strict=True)]
        yield pd.DataFrame({"path": b["event_id"].astype(str), "content": tiles_})


@query("SELECT event_id::VARCHAR AS path, CASE WHEN ok THEN 'places' END AS layer, CASE WHEN ok THEN (event_id * 37 % 4096) / 4096e0 END AS x, CASE WHEN ok THEN 1 - (event_id * 91 % 4096) / 4096e0 END AS y, CASE WHEN ok THEN event_type END AS name, CASE WHEN NOT ok THEN 'broken field' END AS error FROM (SELECT *, event_id % 10 <> 3 AS ok FROM events)")
def mvt_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile an event, one in ten of them broken."""
    files = scratch.spread(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").mapInPandas(_event_tiles, "path string, content binary")
    out = vector_tiles.decode_tiles(files)
    p = F.get(geometry.vertices(F.col("geom")), F.lit(0))
    return out.select("path", "layer", p["x"].alias("x"), p["y"].alias("y"), vector_tiles.prop("name", "string").alias("name"), "error")


@query("""SELECT 'pop' || p_partkey AS id, 'pop' || p_partkey || '-circle' AS layer, '["step",["get","POP"],"rgba(0,0,0,0)",0.0,"rgba(' || p_size || ',0,0,1)",' || p_size || '.0,"rgba(0,0,255,0.502)"]' AS color, '["step",["get","POP"],0.0,0.0,4.0,' || p_size || '.0,8.0]' AS radius FROM part
UNION ALL SELECT 'one' || p_partkey, 'one' || p_partkey || '-circle', '"rgba(' || p_size || ',2,3,1)"', round(p_size * 2 / 3e0, 2)::VARCHAR FROM part""")
def esri_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents a part, with its size as break, colour and marker size."""
    marker = lambda c, s: '{"type":"esriSMS","style":"esriSMSCircle","color":' + c + ',"size":' + s + "}"
    pop = '{"renderer":{"type":"classBreaks","field":"POP","minValue":0,"classBreakInfos":[{"classMaxValue":@,"symbol":' + marker("[@,0,0,255]", "6") + '},{"classMaxValue":60,"symbol":' + marker("[0,0,255,128]", "12") + "}]}}"
    one = '{"renderer":{"type":"simple","symbol":' + marker("[@,2,3]", "@") + "}}"
    part = read(spark, sf_dir, "part")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in (("pop", pop), ("one", one))]))
    docs = part.select("p_partkey", F.col("p_size").cast("string").alias("n"), kinds.alias("s")).select(F.concat("s.k", "p_partkey").alias("id"), F.lit("Point").alias("geometry"), F.replace("s.d", F.lit("@"), "n").alias("info_json"))
    out = drawing_info.layers(docs)
    return out.select("id", "layer", F.col("properties")["circle-color"].alias("color"), F.col("properties")["circle-radius"].alias("radius"))


FLAGSHIP_SQL = f"SELECT tx, ty, fill, count(*) AS n, round(sum(radius), 4) AS radius FROM (SELECT {TILE_SQL.format(n=64)}, CASE class WHEN 'click' THEN 'rgba(255,0,0,255)' WHEN 'purchase' THEN 'rgba(0,128,0,255)' ELSE 'rgba(136,136,136,255)' END AS fill, CASE WHEN coalesce(weight, 0) <= 0 THEN 2e0 WHEN weight >= 200 THEN 10e0 ELSE 2e0 + 8e0 * (weight / 200e0) END AS radius FROM {POINTS_SQL}) GROUP BY 1, 2, 3"


@query(FLAGSHIP_SQL)
def styled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styled points by tile and colour: one scan, one shuffle, no Python."""
    df = points(spark, sf_dir)
    t = tiles.tile_of(F.col("x"), F.col("y"), 6)
    fill = expr(df, ["match", ["get", "class"], "click", "#ff0000", "purchase", "green", "#888888"])
    radius = expr(df, ["interpolate", ["linear"], ["get", "weight"], 0, 2, 200, 10])
    rows = df.select(t["x"].alias("tx"), t["y"].alias("ty"), fill.alias("fill"), radius.alias("radius"))
    return rows.groupBy("tx", "ty", "fill").agg(F.count("*").alias("n"), F.round(F.sum("radius"), 4).alias("radius"))
