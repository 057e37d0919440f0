"""Phrases counted as numbers: what blocks hold, what they send, and who reads the documents."""

from __future__ import annotations

import re

import numpy as np

from cartolake.llm import phrases

TEXTS = [("en", "Big big\tCITY, a  b\n\x0bc"), ("de", "Größe größe. big"), (None, "big city"), ("und", "Big\x00x city!!  "), ("en", ""), ("en", None), ("fr", " .,; \r"), ("en", "one")]


def plain(rows):
    """(lang, pieces of words) of each document."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [p for p in (tuple(w for w in re.split(r"[ \t]+", x) if w) for x in re.split(r"[.,;:!?\n\x0b\x0c\r]", (t or "").translate(lower))) if p]
    return [(lang or "und", p) for lang, t in rows for p in split(t)]


def read(blocks):
    out = []
    for b in blocks:
        words, tongue, seq = phrases._words(b["words"]), phrases._unpacked(b["tongue"], np.uint32), phrases._unpacked(b["seq"], np.uint32)
        piece = []
        for n in [*seq.tolist(), 0]:
            if n:
                piece.append(n - 1)
            elif piece:
                out.append((b["langs"][tongue[piece[0]]], tuple(words[i] for i in piece)))
                assert len({tongue[i] for i in piece}) == 1
                piece = []
        assert {k: v for k, v in zip(b["langs"], b["sizes"], strict=True)} == {k: sum(1 for i in seq[seq > 0] if b["langs"][tongue[i - 1]] == k) for k in b["langs"]}
    return out


def test_blocks_hold_the_pieces(spark, monkeypatch):
    for size in (8, 40, 6 << 20):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        docs = spark.createDataFrame(TEXTS * 3, "lang string, text string")
        assert sorted(read(phrases.tokens(docs).collect())) == sorted(plain(TEXTS * 3))


def test_documents_of_one_task_are_dealt(spark):
    docs = spark.createDataFrame([("en", f"word{i} again") for i in range(400)], "lang string, text string").coalesce(1)
    assert phrases.tokens(docs).count() > 8


def test_rare_words_leave_the_blocks_and_pairs_are_asked_once(spark, monkeypatch):
    rows = [("en", f"rare{i} red fox jumps rare{i}x red fox") for i in range(60)]
    kept, saved = [], phrases.saved
    monkeypatch.setattr(phrases, "saved", lambda df, **o: kept.append(saved(df, **o)) or kept[-1])
    found = phrases.frequent_phrases(phrases.tokens(spark.createDataFrame(rows, "lang string, text string").coalesce(1)), 3, 50)
    assert {(r["phrase"], r["f"]) for r in found.collect()} == {("red", 120), ("fox", 120), ("jumps", 60), ("red fox", 120), ("fox jumps", 60), ("red fox jumps", 60)}
    first = [phrases._unpacked(r["seq"], np.uint32) for r in next(k for k in kept if k.columns == ["block", "seq"]).collect()]
    # red fox jumps, red fox and a zero after each are left of each text
    assert sum(map(len, first)) <= 60 * 7 + len(first) and sum((s > 0).sum() for s in first) == 60 * 5
    for r in kept[-1].sparkSession.createDataFrame([(0, phrases._packed(np.tile(np.array([5, 7, 0], np.uint32), 1000)))], "block long, seq binary").mapInArrow(phrases._pair_requests(4), phrases.PAIRS).collect():
        assert phrases._unpacked(r["w"], np.uint32).tolist() == [1000] and np.cumsum(phrases._unpacked(r["asked"], np.uint64)).tolist() == [5 << 32 | 7]
