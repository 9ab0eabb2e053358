import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of documents: (doc_id, text[, lang, source])."""
    def make(rows, extra=""):
        full = [tuple(r) + ("en", "a", 0)[len(r) - 2:] if len(r) < 5 else tuple(r) for r in rows]
        return spark.createDataFrame(full, DOCS + extra)
    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls in every column, empty and blank texts, repeated rows, one very long text, no white space, odd characters."""
    long = "lorem ipsum dolor sit amet consectetur " * 4000
    return docs([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "),
                 (5, long), (6, "x" * 30_000), (7, "12345 !!! ???"), (8, "été 你好 \U0001f600   end"),
                 (None, "one two three four five six"), (None, None, None, None, None), (9, "ONE two three four five six"),
                 (10, "a", "de", None, 1)])
