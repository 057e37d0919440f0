from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = "word " * 30_000
BASE = "The quick brown fox jumps over the lazy dog and then it sleeps for a while in the sun. "
#: Nulls in any column, empty and long texts, repeated rows, ties, and columns whose names the operators use too.
ROWS = [
    (1, BASE * 3, "en", "a", 7),
    (2, BASE * 2 + "x", "en", "a", 7),
    (2, BASE * 2 + "x", "en", "a", 7),
    (3, "", None, "b", 7),
    (4, None, "en", None, 7),
    (None, BASE, "en", "b", 7),
    (5, "a" * 300, "de", "c", 7),
    (6, "a" * 120, "de", "c", 7),
    (7, "éà " * 80, "fr", "c", 7),
    (8, LONG, "en", "a", None),
    (9, "x\n\n  X \ny", "en", "a", 7),
    (10, "Mail anna@example.com or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111.", "en", "b", 7),
]
COLUMNS = "doc_id long, text string, lang string, source string, n long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in ROWS], COLUMNS + ", h1 string, text_hash string, block int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
