"""Small documents with every edge case: nulls, empties, a long text, ties, repeats, clashing columns."""

from __future__ import annotations

import os

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
EDGE_ROWS = [
    (1, "alpha beta gamma delta", "en", "s", 5, 1, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "s", 0, 1, "x"),
    (4, " \t\n ", "en", "s", 4, 1, "x"),
    (5, "alpha beta gamma delta", "en", "s", 5, 1, "x"),
    (5, "alpha beta gamma delta", "en", "s", 5, 1, "x"),
    (6, LONG, "en", None, 1, 1, "x"),
    (7, "ünï 中文 \U0001f600 é", "fr", "s", 9, None, "x"),
    (None, "no id here", "en", "s", 9, 2, "y"),
    (8, "Alpha Beta gamma delta", "en", "s", 9, 2, "y"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, bucket string"


def edge_docs(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
