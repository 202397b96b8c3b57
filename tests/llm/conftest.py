from __future__ import annotations

import pytest

#: Nulls, empty and blank texts, ties, repeated rows, one very long text; extra columns whose names clash with results'.
EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n", None, "a"),
    (4, "one", "en", "b"),
    (5, "one", "en", "b"),
    (6, "One two three", "en", "b"),
    (7, "alpha beta gamma delta epsilon zeta", "en", "c"),
    (7, "alpha beta gamma delta epsilon zeta", "en", "c"),
    (8, "ALPHA beta gamma delta epsilon zeta", "fr", "c"),
    (9, "\U0001f600 Über straße été 1234 " * 20_000, "de", "a"),
    (10, "!!! 123 ???", None, None),
]
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGE, DOCS)
    for name in ("score", "row", "words", "shard", "component_id", "start", "digest", "_n", "n_hits", "label"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
