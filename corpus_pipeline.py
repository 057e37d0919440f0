"""From documents to token files: quality rules, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All
but the last return the columns of documents. Every stage takes nulls in any column, empty and
very long texts, repeated rows and empty tables; an empty table gives an empty result, and
further columns travel with their rows. doc_id is a whole number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolake.llm.common import saved, scratch_path, table
from cartolake.llm.decontamination import drop_contaminated
from cartolake.llm.jaccard_join import keep_one
from cartolake.llm.mixing import mixed
from cartolake.llm.quality import keep_good
from cartolake.llm.token_output import read_digests, write_tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; a null language or source is a group of its own; repeated rows are judged alike."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id, null ids last. Texts without words are linked with nothing and stay; of repeated rows one stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null texts have no words and stay; repeated rows go or stay together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and empty texts have size 0; a null source is a source of its own; repeated rows are rows of their own."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of each document stand in the token files, and their checksum, read back from the files. A null text has the end id alone; null ids come first."""
    path = scratch_path(spark)
    write_tokens(docs, path)
    return read_digests(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token output", token_output),
]

#: The first stage fits estimates that SQL cannot express; tests compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
