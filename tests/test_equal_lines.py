"""Lines equal in all but their order: the last are drawn, results are those of all."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolake.functions.values import color
from cartolake.operators import raster, stacks


def test_of_equal_lines_the_last_are_drawn(spark, monkeypatch):
    """Faint lines leave pixels open, so all are drawn then; others are settled by the last ones."""
    paths = [[(2.0, 3.0), (9.0, 3.0)], [(5.0, 1.0), (5.0, 9.0), (11.0, 9.0)], [(2.0, 3.0), (9.0, 3.0)]]
    lines = spark.range(900).select(
        F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("canvas"),
        F.when(F.col("id") % 50 != 0, (F.col("id") % 3).cast("int")).alias("layer_ord"),
        F.when(F.col("id") % 41 != 0, F.col("id")).alias("fid"),
        F.element_at(F.lit(F.array(*[F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p]) for p in paths])), (F.col("id") % 3 + 1).cast("int")).alias("pts"),
        F.lit(2.0).alias("line_width"),
        color(0, 0, 0, 128).alias("rgba"),
    )
    faint = lines.withColumn("rgba", color(F.when(F.col("layer_ord") == 1, 200).otherwise(10), 20, 30, F.when(F.col("canvas") == "c1", 2).otherwise(120)))
    drawn, streamed, segments, whole = [], [], raster.segments, stacks._whole_stacks
    for rows, smooth in ((lines, False), (lines, True), (faint, False)):
        want = {tuple(r) for r in raster.blend(raster.strokes(segments(rows, [4.0, 2.0]), 16, 16, "round", smooth)).collect()}
        with monkeypatch.context() as m:
            m.setattr(raster, "segments", lambda x, dashes: drawn.append(x.count()) or segments(x, dashes))
            m.setattr(stacks, "_whole_stacks", lambda flat, place: streamed.append(1) or whole(flat, place))
            drawn.clear()
            streamed.clear()
            got = raster.blended_strokes(rows, 16, 16, "round", smooth, [4.0, 2.0]).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        # a plan for all lines is made, but read only where pixels stay open
        assert sorted(drawn)[1] <= 32 * 6 and max(drawn) == 900
        assert smooth or bool(streamed) == (rows is faint)
