import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with an extra column whose name clashes with inner ones."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in rows], DOCS + ", marks string")

    return make
