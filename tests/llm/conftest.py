import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Frame of (doc_id, text, source) rows, with columns whose names clash with those that operators make."""

    def make(rows, **more):
        full = [(i, t, s, "x", 1) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, slot string, n long")

    return make
