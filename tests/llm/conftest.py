import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, cell string, rank int, score double, __key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, an empty and a long text, repeated rows and ids, and columns whose names operators might use themselves."""
    long_ = " ".join(f"word{k % 97} of{k % 31}" for k in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 1, 0.5, "k"),
        (1, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 1, 0.5, "k"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 1, 0.1, "k"),
        (4, " \n\t \n", "en", "a", 1, 0.1, "k"),
        (5, long_, "en", "a", 1, 0.1, "k"),
        (5, "another text under the same id with other words in it altogether", "en", "a", 1, 0.1, "k"),
        (None, "a text without an id that stands alone in this small table here", "en", "a", 1, 0.1, "k"),
        (None, "a text without an id that stands alone in this small table here", "en", "a", 1, 0.1, "k"),
        (7, "Ünïcode 日本語 ▁ <|endoftext|> \x00   😀 I'LL 'tis", "de", "b", 2, 0.1, "k"),
        (-8, "the quick brown fox jumps over the lazy dog and runs away from her", "en", "a", 1, 0.5, "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 9)], "doc_id long, quality int, toxic int")


def tables(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
