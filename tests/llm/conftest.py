import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("h", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with null cells and extra columns whose names clash with the operators' own."""
    def make(rows, lang=None):
        data = [(i, t, (lang or {}).get(i, "en"), None, None, "x", None) for i, t in rows]
        return spark.createDataFrame(data, DOC_SCHEMA).repartition(3)
    return make


HARD = [(1, None), (2, ""), (3, "   \n\t"), (4, "!!! ### ..."), (5, "one two"), (5, "one two"), (None, "null id text here now"), (6, "zażółć 日本語 \U0001f600 text"),
        (7, "word " * 30_000), (8, "a" * 50_000), (9, "Tie tie TIE tie"), (9, "another text under one id"), (None, None)]


@pytest.fixture(scope="session")
def hard():
    return list(HARD)
