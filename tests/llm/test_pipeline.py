"""The pipeline against a plain Python version of what its stages decide."""

from __future__ import annotations

import zlib

import brute
import corpus_pipeline
import numpy as np

from cartolake.llm import mixing, quality
from cartolake.llm.common import saved

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    from test_llm_operators import tokens_of as f

    return f(text)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    for i, r in rows.items():
        n, *_, rep = brute.statistics(r["text"])
        assert not (i in kept and (n < 50 or 100 * rep > 50 * n))
    left = sorted(kept)
    groups = brute.components([(i, rows[i]["text"]) for i in left], 5, 80)
    left = [i for i, _, c in groups if c == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [i for i in left if not brute.decontaminated(rows[i]["text"], items)[1]]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.filter(docs.doc_id.isin(left))).collect()}
    expected, at = [], 0
    for i in left:
        ids = tokens_of(rows[i]["text"])
        for _ in range(copies[i]):
            expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected


def test_stages_on_odd_and_no_rows(spark, odd):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd.withColumnRenamed("n", "n_chars").select(*columns)
    for rows in (docs, docs.limit(0)):
        at = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = saved(stage(spark, at, SF))
            assert at.columns == columns
            stage(spark, rows, SF).count()
        corpus_pipeline.STAGES[-1][1](spark, at, SF).count()
