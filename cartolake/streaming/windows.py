"""Streams of timed features: windows with late data, and the last place of each entity."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cartolake.operators.tiles import tile_of


def windowed_counts(stream: DataFrame, time_col: str, width: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """(start, end, keys, n, total) for tumbling or sliding windows; rows later than `late` are dropped by the watermark.

    The sliding form is the time-window filter for an unbounded stream.
    """
    rows = stream.withWatermark(time_col, late)
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    total = F.sum(value) if value else F.count("*")
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), total.alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(stream: DataFrame, time_col: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): runs of an entity's rows without a gap."""
    rows = stream.withWatermark(time_col, late)
    return rows.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def tile_counts(stream: DataFrame, time_col: str, width: str, zoom: int, lon: str = "x", lat: str = "y", late: str = "10 minutes") -> DataFrame:
    """Windowed counts by tile."""
    t = tile_of(F.col(lon), F.col(lat), zoom)
    return windowed_counts(stream.withColumns({"tile_x": t["x"], "tile_y": t["y"]}), time_col, width, late=late, keys=("tile_x", "tile_y"))


SEGMENT = "entity long, t0 double, x0 double, y0 double, t1 double, x1 double, y1 double"


def _segments(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last: Any = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["t", "x", "y"])
    out = []
    for r in rows.itertuples(index=False):
        here = (float(r.t), float(r.x), float(r.y))
        if last is not None and here[0] >= last[0]:
            out.append((key[0], *last, *here))
        if last is None or here[0] >= last[0]:
            last = here
    if last is not None:
        state.update(last)
    yield pd.DataFrame(out, columns=["entity", "t0", "x0", "y0", "t1", "x1", "y1"])


def trajectory_segments(stream: DataFrame) -> DataFrame:
    """Segments between an entity's successive places (entity, t, x, y): the last place is the state, older rows are passed over."""
    return stream.select("entity", "t", "x", "y").groupBy("entity").applyInPandasWithState(_segments, SEGMENT, "t double, x double, y double", "append", GroupStateTimeout.NoTimeout)
