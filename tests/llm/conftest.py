"""Small tables with the awkward cases that every operator must stand."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra: str = ""):
        full = [(i, t, lang, src, None if t is None else len(t), *more) for i, t, lang, src, *more in rows]
        return spark.createDataFrame(full, SCHEMA + extra)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls in every column, empty, blank, very long and repeated rows, an id twice, and columns with clashing names."""
    long = prose("en", 99, 30_000)
    rows = [
        (1, prose("en", 1), "en", "a"),
        (2, prose("de", 2), "de", "b"),
        (3, None, "en", "a"),
        (4, "", "fr", None),
        (5, " \n\t ", None, "b"),
        (6, long, "en", "a"),
        (7, prose("fr", 7), None, "a"),
        (7, prose("fr", 8), "fr", "a"),
        (None, prose("de", 9), "de", "b"),
        (1, prose("en", 1), "en", "a"),
        (None, None, None, None),
        (10, "x" * 50_000, "en", "b"),
        (11, "ß🦊 naïve", "fr", "b"),
    ]
    extra = ", fp long, r string, doc string, sampled boolean, spans string, probability double, h string, text_ string"
    return make_docs([(*r, 7, "r", "d", None, "s", 0.5, "h", "t") for r in rows], extra)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
