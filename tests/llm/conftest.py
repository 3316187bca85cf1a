import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text[, lang[, source]])`` rows, with columns whose names clash with internal ones."""

    def make(rows, clash=True):
        full = [(*r, *[None] * (4 - len(r)), 0) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        if clash:
            frame = frame.selectExpr("*", "1 as n", "'x' as cls", "2 as size", "'y' as score", "3 as a", "4 as component", "5 as gram", "6 as slice", "7 as word", "8 as n_words", "'k' as kept", "9 as target")
        return frame

    return make
