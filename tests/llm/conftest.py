import pytest


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, equal texts, a null id."""
    return [
        (1, "One two three four five six"),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, "one two three four five six"),
        (6, "One two three four five six"),
        (6, "One two three four five six"),
        (7, "x"),
        (None, "a null id has a text"),
        (8, "Ünïcödé 日本語 🎉 text " * 50),
        (9, "word " * 40_000),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with further columns, named like columns of results."""
    rows = [(i, t, None if i == 3 else f"s{(i or 0) % 3}", i, "k") for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long, h string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
