import pytest

from deskloom.llm.common import documents

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The whole documents table of the smallest size."""
    return documents(spark, SMALL)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty texts, ties, repeated rows and columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, words, "en", "a", 1, "x"),
        (2, words.upper(), "en", "a", 1, "x"),
        (2, words.upper(), "en", "a", 1, "x"),
        (3, words + " more", None, "b", None, None),
        (4, None, "en", None, 1, "x"),
        (5, "", "en", "b", 1, "x"),
        (None, "one", "en", "b", 1, "x"),
        (None, None, None, None, None, None),
        (8, " \t\n ", "en", "b", 1, "x"),
        (9, "one", "en", "b", 1, "x"),
        (9, "two words", "en", "b", 1, "x"),
        (10, ("long " * 3 + "tail ") * 20000, "en", "c", 1, "x"),
        (11, "ÀÉ été x 😀 line\nline two\r\nthree", "fr", "c", 1, "x"),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, "
    return spark.createDataFrame(rows, names + "`digest` string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.where("false")


def pairs_of(df):
    return [tuple(r) for r in df.collect()]
