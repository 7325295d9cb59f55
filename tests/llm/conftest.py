import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """Whole tables of the smallest size."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
