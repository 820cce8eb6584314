from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows and ids, empty, blank and very long texts, and columns whose names clash with results."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, None, None, None, None), (None, "x y z", "en", "s", 5), (None, "x y z", "en", "s", 5), (None, None, None, None, None),
        (3, "", "en", "s", 0), (4, " \n\t ", "en", "s", 4), (5, long, "en", "s", len(long)), (6, f"intro {passage} end", "en", "s", 1), (7, f"{passage}", "en", "s", 1), (1, f"other {passage} text", "en", "s", 1),
        (8, "x" * 200_000, "en", "s", 200_000), (9, "tie tie tie tie", "en", "s", 15),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("n_words", "doc_key", "component_id", "fp", "_row_key", "words", "kept", "spans", "length", "at"):
        df = df.withColumn(name, F.lit("clash"))
    return df
