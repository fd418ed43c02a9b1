"""Helpers for the tests of the text operators."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

from llm_helpers import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, __note string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) with further columns whose names clash with results."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(prose(3, 30_000)) + "\n" + "a" * 5_000
    return [
        (1, None), (2, ""), (3, "   \n\t "), (None, "no id here"), (None, "no id here"), (4, "### $$$"), (5, "one"), (6, "one"),
        (7, long_text), (7, long_text), (8, long_text), (9, "a\x0bb\x0cc\rd e é中\U0001f600", None), (10, "x y z x y z x y z", None),
    ]
