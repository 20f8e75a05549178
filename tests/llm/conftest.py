import pytest

from textmill.llm.common import table

ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, "a", 5),
    (4, "12345 !!! ###", "de", None, 13),
    (5, "the same words in the same order again and again", "en", "b", 48),
    (6, "the same words in the same order again and again", "en", "b", 48),
    (6, "the same words in the same order again and again", "en", "b", 48),
    (7, "x " * 60_000, "fr", "b", 120_000),
    (None, "a row without a key has five words or more", "en", "c", 42),
    (9, "Grüße é ñ \u4f60\u597d \U0001f600 \x00 end", "de", "c", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a column with a name that operators add."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return table(spark, sf, "documents").cache()


@pytest.fixture(scope="session")
def sf_mid():
    return "/root/testdata/sf0.01"
