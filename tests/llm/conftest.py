import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame (doc_id, text, junk, class, key) of texts or (id, text) pairs; the extra columns clash with inner names."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("fp", StringType()),
                         StructField("class", StringType()), StructField("key", StringType()), StructField("n_chars", LongType())])

    def make(items):
        pairs = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(items)]
        return spark.createDataFrame([(i, t, "x", "y", "z", len(t or "")) for i, t in pairs], schema)

    return make


HARD_TEXTS = [None, "", " ", "\n\t ", "one", "two words", "a b c", "ünïcödé    text 日本", "x" * 30000, "word " * 6000, "same text here", "same text here"]
