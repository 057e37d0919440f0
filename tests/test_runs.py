"""Canvases drawn whole by one task, as runs, against pixels blended in streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cartolake import form_queries, queries  # noqa: F401
from cartolake.operators import render, runs
from cartolake.operators.geometry import GEOMETRY
from cartolake.plans.style import parse_style

BOX = (0.0, 0.0, 20.0, 8.0)
LAYERS = [
    {"id": "areas", "paint": {"fill-color": ["match", ["get", "class"], "a", "rgba(0,0,255,0.4)", "#00ff00"], "line-color": "rgba(9,8,7,0.7)"}},
    {"id": "lines", "layout": {"line-cap": "square"}, "paint": {"line-color": "red", "line-width": ["get", "wide"], "line-opacity": 0.5, "circle-radius": 2}},
]


def features(spark):
    rng = random.Random(5)
    spot = lambda: (rng.uniform(-3, 23), rng.uniform(-3, 11))
    rows = []
    for i in range(160):
        x, y = spot()
        w = rng.uniform(1, 9)
        ring = [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
        hole = [(x + w / 4, y + w / 4), (x + w / 2, y + w / 4), (x + w / 2, y + w / 2)]
        kind, paths = rng.choice([
            ("Point", [(0, False, [(x, y)])]),
            ("MultiPoint", [(0, False, [(x, y)]), (1, False, [(x + 0.3, y)])]),
            ("LineString", [(0, False, [spot(), spot(), spot()])]),
            ("MultiLineString", [(0, False, [spot(), spot()]), (1, False, [spot(), spot()]), (2, False, [spot()])]),
            ("Polygon", [(0, False, ring), (0, True, hole)]),
            ("MultiPolygon", [(0, False, ring), (0, True, hole), (1, False, [spot(), spot(), spot()])]),
        ])
        canvas = None if i % 11 == 0 else f"t{i % 9}" if i % 4 else f"alone{i}"
        rows.append((None if i % 13 == 0 else i, canvas, rng.choice("ab"), float(rng.randint(0, 3)), (kind, paths)))
    rows += [r for r in rows if r[0] and r[0] % 5 == 0]  # repeated rows
    return spark.createDataFrame(rows, f"fid long, tile string, class string, wide double, geom {GEOMETRY}").repartition(3)


@pytest.mark.parametrize("shapes", [4096, 25, 0])
def test_runs_are_the_pixels_blended_one_by_one(spark, monkeypatch, shapes):
    """Whatever canvases go to one task: all, those of at most 25 shapes, or none."""
    monkeypatch.setattr(runs, "SHAPES", shapes)
    df, style = features(spark), parse_style({"layers": LAYERS})
    want = render._pixels(render._styled(df, style, BOX, 40, 16, 0.0, "tile"), style, 40, 16)
    want = sorted(((r["canvas"] or "", r["px"], r["py"], tuple(r["rgba"])) for r in want.collect()))
    got = render.render(df, style, BOX, 40, 16, canvas_col="tile")
    assert sorted(((r["canvas"] or "", r["px"], r["py"], tuple(r["rgba"])) for r in got.collect())) == want and len(want) > 3000


def test_pixels_of_small_canvases_are_not_shuffled(spark):
    df, style = features(spark), parse_style({"layers": LAYERS})
    out = render.render_runs(df, style, BOX, 40, 16, 0.0, "tile")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and text.index("MapInArrow") < text.index("Exchange")
    rows = out.collect()
    assert len(rows) < out.agg(F.sum(F.col("b") - F.col("a") + 1)).first()[0] * 0.6 and all(0 <= r["a"] <= r["b"] < 40 and 0 <= r["py"] < 16 for r in rows)
    assert render.render_runs(df.limit(0), style, BOX, 40, 16, 0.0, "tile").count() == 0
