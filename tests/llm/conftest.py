from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


LONG = "the " + "lorem ipsum dolor sit amet consectetur " * 60_000

EDGES = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (None, "a row without an id but with some words in it", "en", "a", 3),
    (3, "twice the same row\nwith two lines", None, None, None),
    (3, "twice the same row\nwith two lines", None, None, None),
    (4, " \t\n\r \n", "fr", "a", 1),
    (5, LONG, "en", "a", len(LONG)),
    (6, "Ünïcode ▁ é́ 梦 🙂 \x00 done", "de", "a", 9),
    (None, None, None, None, None),
    (7, "twice the same row\nwith two lines", "en", "b", 1),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those the operators make."""
    rows = spark.createDataFrame(EDGES, SCHEMA)
    clashing = ("score", "kept", "row", "id", "digest", "fp", "line", "words", "lang_pred", "c0", "o0", "ids", "trusted")
    return rows.select("*", *(F.lit("x").alias(c) for c in clashing))


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
