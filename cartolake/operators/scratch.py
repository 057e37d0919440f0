"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, removed at exit; where that is unset, in a temporary one in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="cartolake-")
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared.rstrip('/')}/kept-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written to a new folder and read back."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over several tasks a core: for short rows that become many or long ones, whose file is read by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def once(df: DataFrame, key: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `of` adds to rows of its key alone: each value is worked once, null too.

    The values are written, so that few of them are known to be few and joined without a shuffle of
    df; values that hardly repeat are shuffled, twice as many rows as df has.
    """
    values = kept(of(spread(df.select(key).distinct(), key)))
    own = values.withColumnRenamed(key, "_value")
    return df.join(own, df[key].eqNullSafe(own["_value"]), "left").drop("_value")
