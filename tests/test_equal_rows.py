"""Values that rows share are worked once, with results as if every row was worked by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolake import form_queries, queries  # noqa: F401
from cartolake.operators import scratch

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_value_is_worked_once(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i % 5}") for i in range(200)], "id long, t string")
    seen = []

    def of(values):
        seen.extend(r["t"] for r in values.collect())
        return values.withColumn("n", F.coalesce(F.length("t"), F.lit(-1)))

    got = {(r["id"], r["t"], r["n"]) for r in scratch.once(df, "t", of).collect()}
    assert got == {(r["id"], r["t"], len(r["t"]) if r["t"] else -1) for r in df.collect()} and len(got) == 200
    assert sorted(seen, key=str) == [None, "t0", "t1", "t2", "t3", "t4"]


def test_equal_texts_are_read_once(spark):
    text = plan(queries.QUERIES["geom_kinds"](spark, SF))
    assert "BroadcastHashJoin" in text and "ArrowEvalPython" not in text and "SortMergeJoin" not in text
