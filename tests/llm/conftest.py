import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text) pairs, in several partitions, with the columns of the real one."""

    def build(pairs, partitions=3, source=None):
        rows = [(i, t, "en", source(i) if source else "s", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(
            partitions
        )

    return build


#: Texts every operator on texts must take: null, empty, spaces, one word, very long, many blank lines, odd characters.
EDGES = [
    None, "", " \t\n ", "one", "two words", "ein Übel   x", "a" * 70_000, "\n" * 5_000, "x y " * 30_000,
    "same text here", "same text here", "été \U0001f600 z", "quote \"' \\ $1 %s",
]


@pytest.fixture(scope="session")
def edges():
    return list(enumerate(EDGES))
