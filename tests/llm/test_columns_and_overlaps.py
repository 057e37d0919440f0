"""Columns of the input that are named like helpers, and chains of overlapping spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolake.llm import jaccard_join, mixing, pii

NAMES = ("row", "id", "hash", "src", "no", "i", "copy", "copies", "m_id", "text_hash", "no_src", "k", "k_id", "k_hash", "wordy", "_m_copy", "_m_hash", "_m_i", "_m_no", "_m_src", "_k_hash", "_k_words", "component", "n_shingles", "size", "key", "range", "start", "a.b")


def clashing(docs):
    return docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES])


def whole(r):
    return all(r[n] == f"{n}-{'none' if r['doc_id'] is None else r['doc_id']}" for n in NAMES)


def test_mixed_and_keep_one_pass_all_columns_on(spark, odd):
    docs = clashing(odd)
    plain = odd.select("doc_id", "text", "lang", "source")
    for operator in (mixing.mixed, jaccard_join.keep_one):
        got, want = operator(docs), operator(plain)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(whole(r) for r in rows)
        assert sorted(map(repr, (tuple(r)[:4] for r in rows))) == sorted(map(repr, map(tuple, want.collect())))


def test_null_ids_spread_over_keys(spark):
    docs = spark.createDataFrame([(None, f"text {i} " * (i % 7 + 1), "a") for i in range(300)], "doc_id long, text string, source string")
    first, again = [sorted(map(tuple, mixing.mix(d).collect()), key=repr) for d in (docs, docs.repartition(3))]
    assert first == again and len({r[-1] for r in first}) >= 1


def test_chains_of_overlapping_spans(spark):
    cases = {
        "three": ([(0, 10, 0.7), (8, 20, 0.8), (18, 30, 0.9)], [(0, 10), (18, 30)]),
        "middle": ([(0, 10, 0.7), (8, 20, 0.95), (18, 30, 0.9)], [(8, 20)]),
        "equal": ([(0, 10, 0.8), (5, 15, 0.8), (10, 20, 0.8)], [(0, 10), (10, 20)]),
        "inside": ([(0, 40, 0.6), (3, 5, 0.9), (10, 12, 0.7), (50, 60, 0.5)], [(3, 5), (10, 12), (50, 60)]),
        "none": ([], []),
    }
    rows = spark.createDataFrame([(n, [(a, b, "phone", p) for a, b, p in spans]) for n, (spans, _) in cases.items()], "name string, spans array<struct<start:int,end:int,kind:string,p:double>>")
    got = {r["name"]: [(s["start"], s["end"]) for s in r["out"]] for r in rows.select("name", pii._apart(F.col("spans")).alias("out")).collect()}
    assert got == {n: want for n, (_, want) in cases.items()}
