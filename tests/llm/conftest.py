import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of the given (doc_id, text, lang, source) rows."""

    def make(rows):
        rows = [(r + (None, None))[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    return make
