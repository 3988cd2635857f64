import pytest


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a table with more columns, some with names that operators use themselves."""

    def make(rows, shape="doc_id long, text string"):
        data = [(*r, "s", 7, "en") for r in rows]
        return spark.createDataFrame(data, shape + ", source string, key long, lang string")

    return make
