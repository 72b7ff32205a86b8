import pytest


@pytest.fixture
def docs(spark):
    """A table of documents with extra columns, one of which differs from doc_id in case only."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, DOC_ID string, score int")

    return make
