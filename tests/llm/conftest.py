from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text, lang, source); further columns with odd names."""

    def make(rows, extra: bool = False):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        table = spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in full], DOCS)
        if extra:
            from pyspark.sql import functions as F

            names = ("key", "text2", "size", "row", "did", "print", "component", "a", "b", "n", "_key", "_size", "word")
            table = table.withColumns({c: F.lit("odd") for c in names})
        return table

    return make


LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
PROSE = (
    "The river rose slowly over the old stone bridge while the people of the village watched from "
    "their windows and waited for the rain to end because the harvest was still out in the fields. "
)
EDGE = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\x0b ", "en", "a"),
    (4, PROSE * 3, "en", "a"),
    (4, PROSE * 3, "en", "a"),
    (5, PROSE * 3, "en", None),
    (None, PROSE + "tail", "en", "b"),
    (6, "one", "en", "b"),
    (7, LONG, None, "b"),
    (8, "Ünïcode wörds 日本語 😀 \x1c sep", "de", "c"),
    (-3, PROSE * 2 + "other words entirely", "en", "c"),
]


@pytest.fixture(scope="session")
def edge_docs(docs_of):
    return docs_of(EDGE, extra=True)


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
