"""Work that must stay in step with the input: what is hashed, what is shuffled, what is spread."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cartolake import form_queries, queries  # noqa: F401
from cartolake.functions.values import color
from cartolake.operators import classify, raster, stacks

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_last_colour_of_a_pixel_is_hashed_and_null_orders_lie_below(spark):
    rows = [("a", 0, 5, 1), ("a", 0, 7, 2), ("a", 0, None, 3), ("b", None, 9, 4), ("b", 0, 1, 5), ("c", 0, None, 6), ("d", 1, 1, None)]
    df = spark.createDataFrame(rows, "canvas string, layer_ord int, fid long, n int").withColumns({"px": F.lit(0), "py": F.lit(0), "rgba": F.when(F.col("n").isNotNull(), color(F.col("n"), -1, 1 << 20, 255))})
    out = raster.overwrite(df)
    assert {r["canvas"]: r["rgba"] and tuple(r["rgba"]) for r in out.collect()} == {"a": (2, -1, 1 << 20, 255), "b": (5, -1, 1 << 20, 255), "c": (6, -1, 1 << 20, 255), "d": None}
    # the step that sees all pixels is the lowest aggregate
    assert plan(out).rindex("HashAggregate") > plan(out).rindex("SortAggregate")


def test_pixels_of_icons_meet_a_small_atlas_without_a_shuffle(spark):
    text = plan(queries.icon_marks(spark, SF))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text and "REPARTITION_BY_NUM" in text


def test_pixels_of_strokes_are_not_shuffled(spark):
    lines = spark.range(40).select(F.lit("a").alias("canvas"), F.lit(0).alias("layer_ord"), F.col("id").alias("fid"), F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((2.0, 2.0), (9.0, 2.0), (9.0, 300.0))]).alias("pts"), F.lit(2.0).alias("line_width"), color(1, 2, 3).alias("rgba"))
    out = raster.strokes(raster.segments(lines), 16, 400, "round")
    assert "Aggregate" not in plan(out)
    rows = out.groupBy("fid").agg(F.count("*").alias("n"), F.countDistinct("px", "py").alias("d")).collect()
    assert len(rows) == 40 and {(r["n"], r["d"]) for r in rows} == {(rows[0]["n"], rows[0]["n"])} and rows[0]["n"] > 600


def test_last_layers_settle_a_pixel_or_leave_it_to_the_stream(spark, monkeypatch):
    rows = [(px, i, (i * 37 + px) % 256, 3 if px < 4 else 100 + i % 30, 255 if px == 7 and i == 90 else None) for px in range(8) for i in range(200)]
    df = spark.createDataFrame(rows, "px int, fid long, v int, a int, full int").repartition(5)
    df = df.select(F.lit("c").alias("canvas"), F.lit(0).alias("layer_ord"), "fid", "px", F.lit(0).alias("py"), color(F.col("v"), 255 - F.col("v"), 0, F.coalesce("full", "a")).alias("rgba"))
    streamed = []
    whole = stacks._whole_stacks
    monkeypatch.setattr(stacks, "_whole_stacks", lambda flat, place: streamed.extend(r["px"] for r in flat.select("px").distinct().collect()) or whole(flat, place))
    got = {r["px"]: tuple(r["rgba"]) for r in raster.blend(df).collect()}
    for px in range(8):
        own = [r for r in rows if r[0] == px]
        alphas = [r[4] or r[3] for r in own]
        ends = [stacks._run(0, 0, tops, alphas) for tops in ([r[2] for r in own], [255 - r[2] for r in own], [0] * 200)]
        assert got[px] == (ends[0][0], ends[1][0], ends[2][0], ends[0][1])
    # faint layers are streamed whole; most others need their last layers only
    assert {0, 1, 2, 3} <= set(streamed) and len(set(streamed)) < 8


def test_rows_of_one_file_are_dealt_before_they_grow(spark):
    for q in ("geom_kinds", "geom_places", "wkt_wkb_roundtrip", "smooth_fill", "mvt_shapes", "mvt_decode", "esri_layers", "esri_losses"):
        assert "REPARTITION_BY_NUM" in plan(queries.QUERIES[q](spark, SF)), q


def test_a_segment_of_natural_breaks_takes_a_step_a_depth(monkeypatch):
    v = np.sort(np.random.default_rng(3).normal(size=400)).round(1)
    s1, s2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (v, v * v))
    i = np.arange(401)
    before = np.concatenate([[0.0], np.maximum(s2[1:] - s1[1:] ** 2 / i[1:], 0.0)])
    starts = pd.DataFrame({"i": i, "s1": s1, "s2": s2, "cost": before}).iloc[1:400]
    ends = pd.DataFrame({"i": i, "s1": s1, "s2": s2}).iloc[2:]
    steps, spread = [], classify._spread
    monkeypatch.setattr(classify, "_spread", lambda *a: steps.append(1) or spread(*a))
    got = classify._segment_costs((0,), ends.sample(frac=1, random_state=1), starts.sample(frac=1, random_state=2))
    assert len(steps) <= 9
    for e, cost, start in zip(got["i"], got["cost"], got["start"], strict=True):
        x = slice(1, e)
        total = before[x] + spread(s1[x], s2[x], i[x], np.full(e - 1, e), s1[e], s2[e])
        assert cost == total.min() and start == 1 + int(np.argmin(total))
