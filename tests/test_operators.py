"""Operators that SQL doesn't express, against plain Python; and the edges of the others."""

from __future__ import annotations

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cartolake.functions.expressions import Context, compile_expression
from cartolake.functions.registry import FunctionRegistry
from cartolake.functions.values import color
from cartolake.operators import classify, cluster, geometry, labels, raster, temporal, terrain, tiles
from cartolake.operators.filters import FilterBuilder
from cartolake.plans import sld
from cartolake.plans.rules import Rule, cascade
from cartolake.plans.style import StyleError, apply_style, parse_style
from cartolake.sources import geojson
from cartolake.streaming import windows


def value(spark, x, zoom=0.0, **props):
    df = spark.createDataFrame([tuple(props.values()) or (0,)], list(props) or ["nothing"])
    v = compile_expression(x, Context.of(df, zoom, FunctionRegistry.with_builtins()))
    return "refused" if v is None else df.select(v.column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("x", "expected"),
    [
        (["+", 1, 2, 3], 6.0),
        (["-", 5, 2], 3.0),
        (["/", 5, 0], 0.0),
        (["%", -5, 3], -2.0),
        (["%", 5, 0], 0.0),
        (["round", -2.5], -3.0),
        (["zoom"], 7.0),
        (["concat", "a", 1, True], "a1true"),
        (["upcase", "straße"], "STRASSE"),
        (["case", ["==", ["get", "n"], 3], "three", "other"], "three"),
        (["match", ["get", "s"], "x", 1, "y", 2, 0], 2.0),
        (["coalesce", ["get", "missing"], ["get", "s"]], "y"),
        (["step", ["get", "n"], "low", 3, "mid", 9, "high"], "mid"),
        (["interpolate", ["linear"], ["get", "n"], 0, 0, 6, 12], 6.0),
        (["interpolate", ["exponential", 2], ["get", "n"], 0, 0, 6, 1], math.sqrt(2) - 1),
        (["has", "n"], True),
        (["has", "missing"], False),
        (["!", ""], True),
        (["all", ["get", "s"], 1], True),
        (["any", 0, ""], False),
        (["to-number", "2.5"], 2.5),
        (["to-string", 2], "2"),
        (["fn", "clamp", 9, 0, 5], 5.0),
        (["unknown", 1], "refused"),
    ],
)
def test_expressions(spark, x, expected):
    got = value(spark, x, 7.0, n=3.0, s="y")
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def dbscan_plain(pts, eps, least):
    near = {i: [j for j, q in pts.items() if j != i and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for i, p in pts.items()}
    core = {i for i in pts if len(near[i]) >= least}
    label, n = {}, 0
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j in label:
                continue
            label[j] = n
            if j in core:
                todo += [k for k in near[j] if k not in label]
        n += 1
    return {(i, label.get(i), i in core) for i in pts}


def test_dbscan(spark):
    rng = random.Random(5)
    pts = {i: (rng.uniform(-10, 10), rng.uniform(-10, 10)) for i in range(250)}
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "fid long, x double, y double")
    for eps, least in ((1.0, 3), (0.7, 4)):
        assert {tuple(r) for r in cluster.dbscan(df, eps, least).collect()} == dbscan_plain(pts, eps, least)
    assert cluster.dbscan(df.limit(0)).count() == 0


def test_grid_clusters_keep_all_points(spark):
    df = spark.createDataFrame([(i, (i % 7) * 0.4 - 1.2, (i % 3) * 0.9) for i in range(60)], "fid long, x double, y double")
    out = cluster.grid_clusters(df, 0.5, 4, members=True).collect()
    assert sum(r["count"] for r in out) == 60
    assert sorted(m for r in out for m in r["members"]) == list(range(60))


def test_natural_breaks_are_the_best(spark):
    x = [1, 2, 2, 4, 10, 11, 12, 30, 31, 35, 36]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    distinct = sorted(set(x))

    def cost(cuts):
        parts = [distinct[a:b] for a, b in itertools.pairwise([0, *cuts, len(distinct)])]
        return sum(sum((v - sum(p) / len(p)) ** 2 for v in p) for p in parts)

    got = classify.natural_breaks(df, "v", 3)
    best = min(itertools.combinations(range(1, len(distinct)), 2), key=cost)
    assert cost([distinct.index(b) for b in got]) == pytest.approx(cost(best))
    assert classify.natural_breaks(df.limit(0), "v", 3) == []


def test_breaks_of_odd_columns(spark):
    none = spark.createDataFrame([(None,)], "v double")
    same = spark.createDataFrame([(3.0,)] * 5, "v double")
    for df in (none, none.limit(0)):
        assert classify.quantile(df, "v", 4) == classify.equal_interval(df, "v", 4) == classify.standard_deviation(df, "v") == []
    assert classify.quantile(same, "v", 4) == [3.0] * 3
    assert classify.standard_deviation(same, "v") == []


def over(under, top):
    a, b = top[3] / 255, under[3] / 255
    out = a + b * (1 - a)
    if not out:
        return (0, 0, 0, 0)
    return (*[(top[i] / 255 * a + under[i] / 255 * b * (1 - a)) / out * 255 for i in range(3)], out * 255)


def test_blending_follows_paint_order(spark):
    rows = [("c", 0, 1, 5, 5, (255, 0, 0, 128)), ("c", 0, 2, 5, 5, (0, 255, 0, 128)), ("c", 1, 0, 5, 5, (0, 0, 255, 64))]
    kind = "canvas string, layer_ord int, fid long, px int, py int, rgba struct<r:int,g:int,b:int,a:int>"
    for order in itertools.permutations(rows):
        got = raster.blend(spark.createDataFrame(list(order), kind)).first()["rgba"]
        expected = (0, 0, 0, 0)
        for r in rows:
            expected = over(expected, r[5])
        assert all(abs(g - e) <= 3 for g, e in zip(got, expected, strict=True))


def test_fill_with_hole(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    df = spark.createDataFrame([("c", 0, 1, [square(0.0, 8.0), square(2.0, 6.0)])], "canvas string, layer_ord int, fid long, rings array<array<struct<x:double,y:double>>>")
    px = {(r["px"], r["py"]) for r in raster.fills(df.withColumn("rgba", color(1, 2, 3)), 10, 10).collect()}
    assert px == {(x, y) for x in range(8) for y in range(8) if not (2 <= x < 6 and 2 <= y < 6)}


def test_labels_never_overlap(spark):
    rng = random.Random(2)
    rows = [("a" if i % 2 else "b", i, "t", rng.uniform(0, 200), rng.uniform(0, 200), 30.0, 10.0, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "canvas string, fid long, text string, x double, y double, width double, height double, priority int")
    out = labels.place_labels(df, 256, 256).collect()
    assert out
    for p, q in itertools.combinations(out, 2):
        if p["canvas"] == q["canvas"]:
            assert p["x"] + 30 <= q["x"] or q["x"] + 30 <= p["x"] or p["y"] + 10 <= q["y"] or q["y"] + 10 <= p["y"]
    two = spark.createDataFrame([("a", 1, "low", 50.0, 50.0, 30.0, 10.0, 0), ("a", 2, "high", 50.0, 50.0, 30.0, 10.0, 4)], df.schema)
    at = {r["text"]: (r["x"], r["y"]) for r in labels.place_labels(two, 256, 256).collect()}
    assert at["high"] == (50.0, 50.0) and at["low"] != (50.0, 50.0)


def test_contours_of_a_slope(spark):
    dem = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), ((F.col("id") % 10) * 4.0).alias("elev"))
    lines = terrain.contour_lines(dem, 10.0).collect()
    assert {r["level"] for r in lines} == {10.0, 20.0, 30.0}
    assert all(r["x1"] == pytest.approx(r["level"] / 4) and r["x2"] == pytest.approx(r["level"] / 4) for r in lines)


def test_trajectory_ends_and_ties(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 10.0, 10.0, 20.0), (1, 10.0, 10.0, 20.0), (2, 5.0, 1.0, 1.0)], "entity long, t double, x double, y double")
    got = {(r["entity"], r["at"]): (r["x"], r["y"]) for r in temporal.trajectory_at(df, [-1.0, 5.0, 99.0]).collect()}
    assert got == {(1, -1.0): (0.0, 0.0), (1, 5.0): (5.0, 10.0), (1, 99.0): (10.0, 20.0), (2, -1.0): (1.0, 1.0), (2, 5.0): (1.0, 1.0), (2, 99.0): (1.0, 1.0)}


def test_tiles_by_address(spark):
    df = spark.createDataFrame([(1, -180.0, 85.0), (2, 0.0, 0.0), (3, 180.0, -85.06), (4, None, 1.0)], "fid long, x double, y double")
    t = {r["fid"]: r["t"] for r in df.select("fid", tiles.tile_of(F.col("x"), F.col("y"), 3).alias("t")).collect()}
    assert (t[1]["x"], t[1]["y"]) == (0, 0) and (t[2]["x"], t[2]["y"]) == (4, 4) and (t[3]["x"], t[3]["y"]) == (7, 7)
    wanted = spark.createDataFrame([(3, 4, 4), (3, 4, 4), (0, 0, 0)], "z int, x long, y long")
    assert {(r["fid"], r["z"]) for r in tiles.features_in_tiles(df.filter("x IS NOT NULL"), wanted).collect()} == {(2, 3), (1, 0), (2, 0), (3, 0)}


def test_filters_are_never_null(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None)], "s string, n double")
    f = FilterBuilder(df)
    tests = [f.equal("s", "a"), f.not_equal("s", "a"), f.less("n", 5), f.between("n", 0, 5), f.like("s", "a%"), f.equal("missing", 1), f.less("s", 3)]
    rows = df.select(*[c.alias(str(i)) for i, c in enumerate(tests)]).collect()
    assert [tuple(r) for r in rows] == [(True, False, True, True, True, False, False), (False, True, False, False, False, False, False)]


def test_rules_and_sld_round_trip(spark):
    rules = [Rule("a<b", 0).color("line-color", "#123456").number("line-width", 3), Rule("fill", 1).zooms(4.0).color("fill-color", "#abcdef").number("fill-opacity", 0.5)]
    back = sld.parse_sld(sld.to_sld(rules, "l&m"))
    assert [r.name for r in back] == ["a<b", "fill"]
    assert back[0].values["line-color"] == ("color", "#123456") and back[1].values["fill-opacity"] == ("number", 0.5)
    assert back[1].min_zoom == pytest.approx(4.0, abs=1e-4)
    with pytest.raises(ValueError, match="SLD"):
        sld.parse_sld("<a>")
    df = spark.createDataFrame([(1,)], "fid long")
    at = lambda z: cascade(df, back, z).first()["sources"]
    assert "fill-color" not in at(2.0) and at(5.0)["fill-color"] == "fill"


def test_style_errors(spark):
    for bad in ("{", {"layers": 1}, {"layers": [{}]}, {"layers": [{"id": "a", "paint": {"line-dasharray": "x"}}]}):
        with pytest.raises(StyleError):
            parse_style(bad)
    df = spark.createDataFrame([(1, "red")], "fid long, c string")
    style = parse_style({"layers": [{"id": "a", "paint": {"circle-color": ["nope"], "circle-radius": "big"}}]})
    r = apply_style(df, style).first()
    assert r["fill_color"] is None and r["circle_radius"] == 4.0


def test_geojson(spark, tmp_path):
    shapes = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 1}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}, "properties": None},
        {"type": "Feature", "geometry": None, "properties": {}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": ["x"]}, "properties": {}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    rows = geojson.read_geojson(spark, str(tmp_path)).withColumn("area", geometry.area(F.col("geom"))).orderBy("fid").collect()
    assert [(r["fid"], r["geometry_type"], r["area"]) for r in rows] == [(0, "Point", 0.0), (1, "Polygon", 15.0)]
    assert geojson.read_geojson(spark, str(tmp_path), points_only=True).count() == 1
    with pytest.raises(Exception, match="geometry"):
        geojson.read_geojson(spark, str(tmp_path), strict=True).collect()
    assert geojson.parse_bbox("1,2,3,4") == (1.0, 2.0, 3.0, 4.0)
    assert geojson.auto_bbox(spark.createDataFrame([(1.0, 2.0)], "x double, y double")) == (0.0, 1.0, 2.0, 3.0)


def streamed(spark, tmp_path, name, build, rows, kind, mode="append"):
    """Files that arrive one after another, and what a stream over them has put out in the end."""
    src = str(tmp_path / "in")
    for batch in rows:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_windows(spark, tmp_path):
    kind = "entity long, sec double"
    batches = [[(1, 0.0), (1, 30.0), (2, 70.0)], [(1, 4000.0)]]
    build = lambda s: windows.windowed_counts(s.withColumn("ts", F.timestamp_seconds("sec")), "ts", "1 minute", late="1 minute")
    out = streamed(spark, tmp_path, "stream_windows", build, batches, kind)
    assert sorted(r["n"] for r in out) == [1, 2]


def test_stream_trajectories(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    kind = "entity long, t double, x double, y double"
    batches = [[(1, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0)], [(1, 3.0, 2.0, 2.0), (2, 0.0, 5.0, 5.0)]]
    out = streamed(spark, tmp_path, "stream_paths", windows.trajectory_segments, batches, kind)
    assert {(r["entity"], r["t0"], r["t1"]) for r in out} == {(1, 0.0, 1.0), (1, 1.0, 3.0)}


def test_render_blends_in_paint_order(spark):
    """A half-clear line over a fill, in one call: source over, channels cut."""
    from cartolake.operators import render
    from cartolake.plans.style import StyleError, parse_style

    square = geometry.geometry("Polygon", F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (8, 0), (8, 8), (0, 8), (0, 0))]))
    features = spark.range(1).select(F.col("id").alias("fid"), square.alias("geom"))
    style = parse_style({"layers": [{"id": "a", "paint": {"fill-color": "#0000ff"}}, {"id": "b", "paint": {"line-color": "#ff0000", "line-width": 2, "line-opacity": 0.5}}]})
    out = {(r["px"], r["py"]): tuple(r["rgba"]) for r in render.render(features, style, (0.0, 0.0, 16.0, 16.0), 16, 16).collect()}
    # y goes down: the square fills rows 8 to 15
    assert out[4, 12] == (0, 0, 255, 255)
    assert out[4, 8] == (127, 0, 128, 255) and out[4, 7] == (255, 0, 0, 127)
    assert (12, 12) not in out and {(x, y) for x, y in out if x < 7 and y > 8} == {(x, y) for x in range(7) for y in range(9, 16)}
    with pytest.raises(ValueError):
        render.render(features, style, (0.0, 0.0, 1.0, 1.0), 0, 4)
    style.layers = []
    with pytest.raises(StyleError):
        render.render(features, style, (0.0, 0.0, 1.0, 1.0), 4, 4)


def test_bevels_close_the_outer_corner(spark):
    from cartolake.operators import raster, render
    from cartolake.functions import values

    line = F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in ((2, 4), (10, 4), (10, 12))])
    lines = spark.range(1).select(F.lit("a").alias("canvas"), F.lit(0).alias("layer_ord"), F.col("id").alias("fid"), line.alias("pts"), F.lit(4.0).alias("line_width"), values.color(0, 0, 0).alias("rgba"))
    found = {j: {(r["px"], r["py"]) for r in render._line_pixels(lines, 16, 16, "butt", j, None).collect()} for j in ("bevel", "round")}
    plain = {(r["px"], r["py"]) for r in raster.strokes(raster.segments(lines), 16, 16).collect()}
    assert plain < found["bevel"] <= found["round"]
    assert (10, 3) in found["bevel"] and (11, 2) not in found["bevel"]
