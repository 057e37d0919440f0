"""What the operators of this subpackage share: text rules and the shared folder."""

from __future__ import annotations

import atexit
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and line rules: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Words of letters and digits: ASCII ones and everything from \x80 on, after ascii_lower.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts that are all ASCII take the faster lower()."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder is set in local mode, as in tests; on a cluster that would
    be lost, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cartolake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch space
        pass


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/cartolake-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def saved(df: DataFrame, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing that was written."""
    path = scratch_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_pair(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they name a value."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *columns).alias("h2")]


def space_words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), lambda w: w != "")


def alnum_words(text: Column) -> Column:
    """The words of letters, digits and all from \\x80 on, A-Z lower-cased; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP, -1), lambda w: w != "")
