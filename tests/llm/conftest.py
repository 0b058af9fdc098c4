import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(rows):
        """Documents from (doc_id, text) pairs or whole rows."""
        full = [r if len(r) == 5 else (*r, "en", "src1", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make
