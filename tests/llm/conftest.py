import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
PASSAGE = "one passage that many of the documents share in whole, long enough to hold more than a hundred bytes and thirteen words or more"

#: doc_id, text: null, empty and wordless texts, a null id, a repeated row, equal and nearly equal texts, a very long one.
TEXTS = [
    (1, f"The first document says: {PASSAGE}. It ends here."),
    (2, f"Another one begins otherwise, {PASSAGE} and goes on to speak of other things."),
    (3, f"The first document says: {PASSAGE}. It ends here."),
    (3, f"The first document says: {PASSAGE}. It ends here."),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, LONG),
    (8, LONG + " changed"),
    (9, "größer straße — überall naïve 漢字 \U0001f600 text"),
    (10, "a" * 5000),
    (None, "a row without an id, which no operator may lose"),
    (11, "one two"),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """The texts with the columns of documents and columns whose names operators use inside."""
    rows = [(i, t, "en" if i else None, "src", len(t or ""), 1, "x", [1], "y") for i, t in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, spans string, hits array<int>, fp string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
