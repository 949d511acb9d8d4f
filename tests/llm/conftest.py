import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with some columns more, whose names the operators might use themselves."""

    def make(texts, ids=None):
        ids = ids if ids is not None else range(len(texts))
        rows = [(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, root string")

    return make


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of(["x"]).limit(0)
