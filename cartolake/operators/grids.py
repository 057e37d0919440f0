"""Grids as blocks of cells, and stencils over them that exchange nothing but the cells along block borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells a side of a block.
SIDE = 256
#: What a stencil sums up: for each name the neighbours' places relative to a cell, and their factors.
Kernels = dict[str, tuple[tuple[int, int, float], ...]]


def blocks(cells: DataFrame, value: str = "elev", side: int = SIDE) -> DataFrame:
    """(block_row, block_col, places, heights) of cells (row, col, value), one shuffle: the form that grids are best kept in.

    A place is row * side + column inside the block. Null values are cells that don't exist; of a
    cell that comes more than once the highest value counts. A block has at most side * side places.
    """
    r, c = F.floor(F.col("row") / side).cast("long"), F.floor(F.col("col") / side).cast("long")
    place = (F.pmod("row", F.lit(side)) * side + F.pmod("col", F.lit(side))).cast("int")
    rows = cells.select(r.alias("block_row"), c.alias("block_col"), place.alias("place"), F.col(value).cast("double").alias("h"))
    # cells are dealt by block once; both groupings keep that partitioning
    dealt = rows.filter("place IS NOT NULL AND h IS NOT NULL").repartition("block_row", "block_col")
    once = dealt.groupBy("block_row", "block_col", "place").agg(F.max("h").alias("h"))
    got = once.groupBy("block_row", "block_col").agg(F.collect_list(F.struct("place", "h")).alias("p"))
    return got.select("block_row", "block_col", F.col("p.place").alias("places"), F.col("p.h").alias("heights"))


def _stencil(kernels: Kernels, side: int, inner: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each block over its own cells and those around it: of the cells that only it reaches, or of the others."""
    offsets = sorted({(dr, dc) for kernel in kernels.values() for dr, dc, _ in kernel})
    whole = np.zeros((side + 2, side + 2), bool)
    whole[2:side, 2:side] = True
    for batch in batches:
        for block in batch.itertuples():
            height, there = np.zeros(side * side), np.zeros(side * side, np.int64)
            height[block.places], there[block.places] = block.heights, 1
            height, there = height.reshape(side, side), there.reshape(side, side)
            sums = {name: np.zeros((side + 2, side + 2), there.dtype if name == "n" else height.dtype) for name in ("n", *kernels)}
            at = lambda dr, dc: (slice(1 - dr, 1 - dr + side), slice(1 - dc, 1 - dc + side))
            for dr, dc in offsets:
                sums["n"][at(dr, dc)] += there
            for name, kernel in kernels.items():
                for dr, dc, factor in kernel:
                    sums[name][at(dr, dc)] += factor * height
            r, c = np.nonzero((sums["n"] > 0) & (whole if inner else ~whole))
            yield pd.DataFrame({"row": r + (block.block_row * side - 1), "col": c + (block.block_col * side - 1), **{name: s[r, c] for name, s in sums.items()}})


def _sums(rows: DataFrame, kernels: Kernels, side: int, inner: bool) -> DataFrame:
    if side < 3:
        raise ValueError("a block has at least 3 cells a side")
    schema = "row long, col long, n long, " + ", ".join(f"`{k}` double" for k in kernels)
    return rows.mapInPandas(lambda batches: _stencil(kernels, side, inner, batches), schema)


def seams(rows: DataFrame, kernels: Kernels, side: int = SIDE) -> DataFrame:
    """What blocks have of cells that more than one block reaches: at most 8 rows for each cell of a side."""
    return _sums(rows, kernels, side, inner=False)


def stencil(rows: DataFrame, kernels: Kernels, side: int = SIDE) -> DataFrame:
    """(row, col, n, one sum for each kernel) of blocks: n counts the cell's neighbours that exist; cells with none don't come.

    Neighbours are at most one row and one column off. Sums inside a block are whole where it lies;
    only those along its border are shuffled and added up, 3 % of the cells of full blocks.
    """
    border = seams(rows, kernels, side).groupBy("row", "col").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in kernels])
    return _sums(rows, kernels, side, inner=True).unionByName(border)
