import pytest


@pytest.fixture()
def docs(spark):
    """Make a documents table of (doc_id, text) pairs, with columns that clash with the operators' own."""

    def make(pairs, kind="long"):
        rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in pairs]
        return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars int, kept int, spans string")

    return make


#: Nulls in ids and texts, empty and blank texts, ties and repeated rows, a very long text.
ODD = [(None, "null id here and more words to read"), (1, None), (2, ""), (3, " \n\t "), (4, "same words again here"), (4, "same words again here"), (5, "long " * 40_000), (6, "é👍 中文   \x0b x")]


@pytest.fixture()
def odd(docs):
    return docs(ODD)
