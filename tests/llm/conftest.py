import os

import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows every operator must take: nulls, empty, wordless and long texts, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 700}é" for i in range(30_000))
    again = "the same text stands in two rows and in a third one with another id " * 20
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "a"), (5, again, "b"), (5, again, "b"), (6, again, "b"),
        (None, "a row without an id", "a"), (7, "x", "a"), (8, "<|endoftext|> 's don't we'll  see\n\n", "a"),
    ]
    names = ["k1", "row", "score", "host", "copies", "shard", "c", "body"]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, "en", len(r[1] or ""), *names) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def schema(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])
