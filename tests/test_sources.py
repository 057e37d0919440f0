"""Files: one file in pieces, tiles with what is asked for, one file a canvas."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cartolake.operators import svg
from cartolake.queries import _tile_bytes
from cartolake.sources import canvases, geojson, pieces, vector_tiles

NASTY = [
    'plain', 'quote " and \\ slash', 'ends in slashes \\\\', '{"type":"Feature"}', '[[[{{{', '"features":[{', "é ü 漢字 🙂", "", '\\"', ']}]}',
]


def collection():
    shapes = []
    for i in range(60):
        props = {"i": i, "name": NASTY[i % len(NASTY)], NASTY[(i + 3) % len(NASTY)]: i, "inner": {"type": "Feature", "features": [{"a": 1}, {"b": []}]}}
        kind = i % 4
        geom = {"type": "Point", "coordinates": [i, -i]} if kind < 2 else {"type": "LineString", "coordinates": [[0, 0], [i, i]] * (1 + i)} if kind == 2 else None
        shapes.append({"type": "Feature", "geometry": geom, "properties": props})
    return shapes


def written(style):
    shapes = collection()
    whole = {"type": "FeatureCollection", "crs": {"properties": {"features": [{"x": 1}]}}, "other": [{"y": "features"}, {}], "features": shapes, "after": [{"z": 2}]}
    if style == "spaced":
        return json.dumps(whole, indent=3, ensure_ascii=False).replace('"features": [', '"features"  \n:' + " " * 300 + "[", 3)
    return json.dumps(whole, ensure_ascii=style == "escaped", separators=(",", ":"))


@pytest.mark.parametrize(("style", "piece"), [("compact", 13), ("escaped", 64), ("spaced", 101), ("compact", 1000), ("compact", 1 << 24)])
def test_features_of_pieces(spark, tmp_path, style, piece, monkeypatch):
    """Cuts anywhere, also inside strings, escapes and characters: features and their numbers as in the whole file."""
    monkeypatch.setattr(pieces, "MOST_TASKS", 4)
    (tmp_path / "a b.json").write_text(written(style), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"type":"FeatureCollection","features":[]}')
    got = {r["fid"]: json.loads(r["text"]) for r in pieces.feature_texts(spark, str(tmp_path), piece).collect()}
    assert got == dict(enumerate(collection()))


def test_pieces_give_what_the_whole_file_gives(spark, tmp_path):
    (tmp_path / "a.json").write_text(written("compact"), encoding="utf-8")
    row = lambda df: sorted(map(str, df.select("fid", "geometry_type", "geom", F.to_json("props").alias("p")).collect()))
    for points_only in (False, True):
        assert row(geojson.read_pieces(spark, str(tmp_path), points_only, piece=500)) == row(geojson.read_geojson(spark, str(tmp_path), points_only))
    with pytest.raises(Exception, match="geometry"):
        geojson.read_pieces(spark, str(tmp_path), strict=True).collect()


def test_a_feature_without_end_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"a":1},{"b":')
    with pytest.raises(Exception, match="doesn't end"):
        pieces.feature_texts(spark, str(tmp_path)).collect()


def test_tiles_read_what_is_asked_for(spark, tmp_path):
    """A condition on the layer reaches the reader and leaves the plan; results are those of a filter after it."""
    for i in range(9):
        (tmp_path / f"{i}.mvt").write_bytes(_tile_bytes("roads", i, 2 * i, f"r{i}") + _tile_bytes("places", i, i, f"p{i}"))
    (tmp_path / "broken.mvt").write_bytes(b"\x1a\xff\x00")
    got = {}
    for pushed in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        for layer in ("roads", "places", "none"):
            df = vector_tiles.read_tiles(spark, str(tmp_path), tags=("name",)).filter(F.col("layer") == layer)
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert ("Filter (" in plan) == (pushed == "false"), plan
            got[pushed, layer] = sorted((r["layer"], r["fid"], r["props"]["name"]["text"], str(r["geom"])) for r in df.collect())
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    for layer in ("roads", "places", "none"):
        assert got["true", layer] == got["false", layer]
        assert vector_tiles.read_tiles(spark, str(tmp_path), layer).count() == len(got["true", layer])
        assert len(got["true", layer]) == (0 if layer == "none" else 9)
    every = vector_tiles.read_tiles(spark, str(tmp_path), tags=("other",)).collect()
    assert len(every) == 19 and sum(r["error"] is not None for r in every) == 1
    assert not any(r["props"] for r in every)


def files(path):
    return {f.name: f.read_bytes() for f in path.glob("part-*/*") if not f.name.endswith(".crc")}


def test_svg_files_are_the_documents(spark, tmp_path):
    names = ["a", "b/c", "%", None, "ü x", "."]
    rows = [(names[i % 6], i % 3, i * 7 % 50, f"<g>{i}</g>") for i in range(300)]
    df = spark.createDataFrame(rows, "canvas string, layer_ord int, fid int, element string").repartition(5)
    canvases.write_svg(df, str(tmp_path / "out"), 10, 20.5, "a < b")
    want = {r["canvas"]: r["svg"].encode() for r in svg.documents(df, 10, 20.5, "a < b").collect()}
    got = files(tmp_path / "out")
    assert got == {f"{file}.svg": want[canvas] for file, canvas in (("a", "a"), ("b%2Fc", "b/c"), ("%25", "%"), ("%00", None), ("%C3%BC%20x", "ü x"), (".", "."))}
    assert (tmp_path / "out" / "_SUCCESS").exists() and not (tmp_path / "out" / "_temporary").exists()
    with pytest.raises(FileExistsError):
        canvases.write_svg(df, str(tmp_path / "out"), 10, 20.5)
    canvases.write_svg(df.limit(0), str(tmp_path / "none"), 1, 1)
    assert files(tmp_path / "none") == {}


def test_pixel_files(spark, tmp_path):
    """Pixels of two canvases with gaps between rows and in them."""
    pixels = {("a", 1, 2): (1, 2, 3, 4), ("a", 4, 0): (255, 0, 7, 255), ("a", 4, 3): (9, 9, 9, 9), ("b", 0, 0): (5, 6, 7, 8)}
    df = spark.createDataFrame([(c, x, y, rgba) for (c, y, x), rgba in pixels.items()], "canvas string, px int, py int, rgba struct<r:int,g:int,b:int,a:int>")
    canvases.write_pixels(df, str(tmp_path / "out"), 4, 6)
    want = {c: bytearray(4 * 4 * 6) for c in "ab"}
    for (c, y, x), rgba in pixels.items():
        want[c][(y * 4 + x) * 4 : (y * 4 + x) * 4 + 4] = bytes(rgba)
    assert files(tmp_path / "out") == {f"{c}.rgba": bytes(v) for c, v in want.items()}
    with pytest.raises(Exception, match="outside"):
        canvases.write_pixels(df, str(tmp_path / "low"), 4, 3)
    assert files(tmp_path / "low") == {} and not (tmp_path / "low" / "_temporary").exists()


def test_collections_come_back(spark, tmp_path):
    rows = [(f"c{i % 3}", i, json.dumps(f)) for i, f in enumerate(collection())]
    canvases.write_collections(spark.createDataFrame(rows, "canvas string, fid long, text string"), str(tmp_path / "out"))
    got = sorted((r["path"].rsplit("/", 1)[1], r["fid"], json.loads(r["text"])["properties"]["i"]) for r in pieces.feature_texts(spark, str(tmp_path / "out" / "part-*"), 300).collect())
    assert got == [(f"c{k}.json", n, 3 * n + k) for k in range(3) for n in range(20)]


def test_a_large_canvas_is_joined_over_tasks_and_features_are_parsed_once(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.col("fid"), F.lit(',0.5]},"properties":{"n":"'), F.repeat(F.lit("é"), (F.col("fid") % 90).cast("int")), F.lit('"}}'))
        rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, None).otherwise("big").alias("canvas"), (F.lit(20_000) - F.col("id")).alias("fid")).withColumn("text", one).repartition(3)
        chunks = canvases._chunks(rows.selectExpr("canvas", "fid", "CAST(NULL AS INT) AS place", "text AS content"), ("fid",), ",\n").filter("canvas = 'big'")
        assert chunks.select("part").distinct().count() > 1 and chunks.count() < 300
        canvases.write_collections(rows, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    texts = {}
    for r in sorted(rows.collect(), key=lambda r: r["fid"]):
        texts.setdefault(r["canvas"], []).append(r["text"])
    want = {name: ('{"type":"FeatureCollection","features":[' + ",\n".join(texts[canvas]) + "]}").encode() for name, canvas in (("big.json", "big"), ("%00.json", None))}
    assert files(tmp_path / "out") == want
    back = geojson.read_pieces(spark, str(tmp_path / "out" / "part-*"), piece=1 << 18)
    assert back.count() == 20_000
    # the filter on a geometry stays above the step that parses its text
    assert back._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
