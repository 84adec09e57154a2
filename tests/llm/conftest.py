import pytest
from pyspark.sql import types as T


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, …) as a documents table with columns that clash with results."""

    def make(rows, extra="doc_id long, text string, lang string, source string"):
        return spark.createDataFrame([tuple(r) for r in rows], extra)

    return make


@pytest.fixture
def empty(spark):
    def make(ddl):
        return spark.createDataFrame([], T._parse_datatype_string(ddl))

    return make
