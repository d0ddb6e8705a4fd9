"""Small frames for the training-data operators: edge cases in one place."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL  # noqa: F401

#: (doc_id, text): null and empty texts, a null id, ties, repeated rows.
ROWS = [
    (1, "The cat sat on the mat and looked at the moon. It was late."),
    (2, "The cat  sat on the\tmat and looked at the moon.\nIt was late."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "word"),
    (7, "The cat sat on the mat and looked at the moon. It was late."),
    (7, "The cat sat on the mat and looked at the moon. It was late."),
    (None, "Nobody knows this one's id, 42 times!"),
    (9, "Éléphant straße naïve — “quoted” 日本語 text 123 456\r\n\r\nNext paragraph."),
    (10, "x" * 5000 + " " + "y " * 3000),
]


def frame(spark, rows=None):
    """The rows with extra columns whose names clash with internal ones."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame(
        [(i, t, None, "src", len(t) if t else None, 7, "h") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, id long, norm string")


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest input as Python pairs, by id."""
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)
