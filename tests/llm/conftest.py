import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, lang, source) rows."""
    return lambda rows: spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)
