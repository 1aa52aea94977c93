import pytest

from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that operators use inside or return.
    T.StructField("_row", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("kept", T.StringType()), T.StructField("_words", T.StringType()),
    T.StructField("node", T.LongType()), T.StructField("_hits", T.StringType()),
])


def doc(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "r", 1, "k", "w", 2, "h")


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: spark.createDataFrame([doc(*r) if isinstance(r, tuple) else doc(*r) for r in rows], DOC)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
