"""Stencils over blocks against plain loops, and what they shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cartolake.operators import grids, terrain

KERNELS = {**terrain.HORN, "next": ((0, 1, 1.0), (1, 1, 10.0))}


def by_hand(cells):
    heights = {}
    for r, c, h in cells:
        if h is not None:
            heights[r, c] = max(h, heights.get((r, c), h))
    offsets = {(dr, dc) for k in KERNELS.values() for dr, dc, _ in k}
    out = {}
    for r, c in {(r - dr, c - dc) for r, c in heights for dr, dc in offsets}:
        n = sum((r + dr, c + dc) in heights for dr, dc in offsets)
        out[r, c] = (n, *[round(sum(f * heights.get((r + dr, c + dc), 0.0) for dr, dc, f in k), 6) for k in KERNELS.values()])
    return out


@pytest.mark.parametrize("side", [3, 4, 7, 64])
def test_stencil_over_blocks(spark, side):
    """Whole rows, gaps, null and repeated cells and rows below zero."""
    cells = [(r, c, float((r * 37 + c * 91) % 23)) for r in range(-4, 17) for c in range(-2, 13) if (r * c) % 11 != 5]
    cells += [(2, 2, 99.0), (40, 3, 1.5), (41, 90, None), (3, 3, None)]
    df = spark.createDataFrame(cells, "row int, col int, elev double")
    got = grids.stencil(grids.blocks(df, side=side), KERNELS, side).collect()
    assert len(got) == len({(r["row"], r["col"]) for r in got})
    assert {(r["row"], r["col"]): (r["n"], *[round(r[k], 6) for k in KERNELS]) for r in got} == by_hand(cells)
    assert grids.stencil(grids.blocks(df.limit(0), side=side), KERNELS, side).count() == 0


def test_seams_are_few(spark):
    """A million cells: a twentieth of them at most goes through the shuffle of a stencil."""
    i = F.col("id")
    df = spark.range(1 << 20).select((i / 1024).cast("int").alias("row"), (i % 1024).cast("int").alias("col"), (i % 97).cast("double").alias("elev"))
    blocks = grids.blocks(df)
    assert grids.seams(blocks, terrain.HORN).count() < (1 << 20) / 20
    shuffles = grids.stencil(blocks, terrain.HORN)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(row")
    assert shuffles == 1


def test_small_blocks_are_refused(spark):
    with pytest.raises(ValueError, match="3 cells"):
        grids.stencil(grids.blocks(spark.createDataFrame([(0, 0, 1.0)], "row int, col int, elev double")), KERNELS, 2)
