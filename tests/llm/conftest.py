from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture
def make(spark):
    """Builds a table from a DDL schema and rows."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "the cat sat on the mat, and the dog did not."),
    (5, "the  cat sat\non the mat, and the dog did not."),
    (6, "word " * 30000 + "end"),
    (7, "x" * 50000),
    (8, "Été à la plage \U0001f600 日本 語。 <|endoftext|> <|im_end|>"),
    (None, "a row without an id"),
    (4, "another text under a repeated id"),
    (9, "the same row twice over and over"),
    (9, "the same row twice over and over"),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    names = ["key", "tie", "curve", "ids", "rep", "sha", "kept", "lang", "source"]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
        + [T.StructField(n, T.StringType()) for n in names]
    )
    return spark.createDataFrame(
        [(i, t, *["z"] * 7, "en", None) for i, t in ODD_TEXTS], schema
    )


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
