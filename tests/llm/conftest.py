import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of texts, or of (doc_id, text, lang, source)."""

    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, lang, source = r if isinstance(r, tuple) else (i, r, "en", "s")
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCUMENT)

    return make
