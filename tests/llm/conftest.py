"""Fixtures of the corpus operators: awkward documents, and plain-Python words and shingles to compare with."""

from __future__ import annotations

import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"palabra{i % 977} und{i % 31}" for i in range(60_000))

AWKWARD = [
    (1, "", "en"),
    (2, None, None),
    (3, "One", "en"),
    (4, "É à l'été, ça va? \U0001f600 日本語", "fr"),
    (5, LONG, "de"),
    (5, LONG, "de"),
    (6, "   \n\t ", "en"),
    (None, "a row without an id but with some words in it", "en"),
    (8, "same text here and there again and again", "en"),
    (9, "same text here and there again and again", "en"),
    (10, "!!! ??? ...", None),
]
COLUMNS = "doc_id long, text string, lang string, place long, score double, _row string, node binary, ranges int"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, size: int = 5) -> Counter:
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward documents with further columns whose names the operators use inside."""
    rows = [(i, t, lang, 7, 0.5, "x", b"n", 3) for i, t, lang in AWKWARD]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
