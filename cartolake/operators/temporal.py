"""Time: windows with fading, keyframes, and places along trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.operators.ranges import in_ranges
from cartolake.operators.scratch import kept


def time_value(df: DataFrame, column: str) -> Column:
    """Seconds from numbers, numeric texts or timestamps; null where there are none."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    return c.try_cast("double")


def in_range(t: Column, start: float, end: float) -> Column:
    return F.coalesce(t.between(start, end), F.lit(False))


def time_window(df: DataFrame, now: float, window: float, time_col: str = "t", fade: bool = False) -> DataFrame:
    """Rows of the last `window` seconds up to now, ends included, with opacity: 1, or falling to 0 with age.

    A window of 0 has no age to speak of: its opacity is NaN when fading.
    """
    t = time_value(df, time_col)
    rows = df.withColumn("_t", t).filter(F.col("_t").between(now - window, now))
    fading = (F.lit(1.0) - (F.lit(float(now)) - F.col("_t")) / window) if window else F.lit(float("nan"))
    return rows.withColumn("opacity", fading if fade else F.lit(1.0)).drop("_t")


def keyframes(df: DataFrame, start: float, end: float, frames: int, window: float, time_col: str = "t", fade: bool = False) -> DataFrame:
    """Each row in every frame that shows it: frame, frame_time, opacity.

    Frames lie evenly over start..end. Which ones show a row follows from its time, so rows are
    generated into their frames and nothing is joined.
    """
    gap = (end - start) / (frames - 1) if frames > 1 else 0.0
    t = F.col("_t")
    rows = df.withColumn("_t", time_value(df, time_col)).filter("_t IS NOT NULL")
    if gap > 0:
        first = F.greatest(F.lit(0).cast("long"), F.floor((t - start) / gap))
        last = F.least(F.lit(frames - 1).cast("long"), F.ceil((t + window - start) / gap))
        found = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    else:
        found = F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))
    rows = rows.withColumn("frame", F.explode(found)).withColumn("frame_time", F.lit(float(start)) + F.col("frame") * gap)
    rows = rows.filter(t.between(F.col("frame_time") - window, F.col("frame_time")))
    fading = (F.lit(1.0) - (F.col("frame_time") - t) / window) if window else F.lit(float("nan"))
    return rows.withColumn("opacity", fading if fade else F.lit(1.0)).drop("_t")


def trajectory_at(points: DataFrame, times: list[float] | DataFrame, entity: str = "entity", t: str = "t", x: str = "x", y: str = "y") -> DataFrame:
    """(entity, at, x, y) for each time: between the first pair of points around it, the end points beyond.

    times is a list of seconds, asked of every entity, or a table (entity, at) of any size: an
    as-of join from both sides. Points and asked times lie in ranges of entity and time, so one
    entity may fill many tasks; the last and the first point that a range has of an entity, a row
    each, are carried over the ranges after and before it. A time without points of its entity
    has no row; nor has a null time. Entities may be null.
    """
    own = points.select(F.col(entity).alias("_e"), F.col(t).cast("double").alias("_t"), F.struct(F.col(t).cast("double").alias("t"), F.col(x).alias("x"), F.col(y).alias("y")).alias("_p")).filter("_t IS NOT NULL")
    if isinstance(times, DataFrame):
        asked = times.select(F.col(entity).alias("_e"), F.col("at").cast("double").alias("_t")).filter("_t IS NOT NULL")
    else:
        asked = own.select("_e").distinct().select("_e", F.explode(F.array(*[F.lit(float(v)) for v in times])).alias("_t"))
    rows = own.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    # rows of one entity and time share a range, so ranges end between times
    ranges = in_ranges(rows, "_e", "_t", part="_part")
    order = F.struct("_t", "_p.x", "_p.y")
    ends = ranges.filter("NOT _asked").groupBy("_part", "_e").agg(F.max_by("_p", order).alias("_end"), F.min_by("_p", order).alias("_begin"))
    ends = kept(ranges.select("_part", "_e").distinct().join(ends.withColumnsRenamed({"_part": "_q", "_e": "_f"}), F.col("_part").eqNullSafe(F.col("_q")) & F.col("_e").eqNullSafe(F.col("_f")), "left"))
    over = Window.partitionBy("_e").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("_e").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    told = ends.select(F.col("_part").alias("_q"), F.col("_e").alias("_f"), F.last("_end", ignorenulls=True).over(over).alias("_from"), F.last("_begin", ignorenulls=True).over(back).alias("_to"))
    nearest = F.last("_p", ignorenulls=True)
    before = Window.partitionBy("_part", "_e").orderBy("_t", F.col("_asked").desc(), "_p.x", "_p.y").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_part", "_e").orderBy(F.col("_t").desc(), "_asked", F.col("_p.x").desc(), F.col("_p.y").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = ranges.withColumns({"_a": nearest.over(before), "_b": nearest.over(after)}).filter("_asked")
    found = found.join(told, F.col("_part").eqNullSafe(F.col("_q")) & F.col("_e").eqNullSafe(F.col("_f")))
    found = found.withColumns({"_a": F.coalesce("_a", "_from"), "_b": F.coalesce("_b", "_to")}).filter("_a IS NOT NULL OR _b IS NOT NULL")
    part = (F.col("_t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    place = lambda c: F.when(F.col("_a").isNull(), F.col(f"_b.{c}")).when(F.col("_b").isNull(), F.col(f"_a.{c}")).otherwise(F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * part)
    return found.select(F.col("_e").alias(entity), F.col("_t").alias("at"), place("x").alias("x"), place("y").alias("y"))
