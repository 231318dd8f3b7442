"""Small documents with the awkward cases that every operator has to stand."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts: ids in order, with the columns of the documents table."""

    def build(texts, ids=None, lang="en"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [
            (i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)
        ]
        return spark.createDataFrame(rows, DOC)

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [tuple(r) for r in documents.collect()]


ODD_TEXTS = [
    None, "", "   \t\n ", "one", "a b c d e", "a b c d e", "éè 中文 \U0001f600 x y",
    "same line\nsame line\n\nsame line", "word " * 30000, "x" * 70000, "A B C D E F", "a\x1cb \x85c",
]


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, blanks, very long words and texts, ties, repeated rows and ids."""
    ids = [*range(len(ODD_TEXTS) - 2), None, 3]
    odd = docs_of(ODD_TEXTS, ids)
    return odd.unionByName(odd.limit(5))
