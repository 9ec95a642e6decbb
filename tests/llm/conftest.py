import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, rid string, rank string"
#: Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names operators use themselves.
ODD = [
    (1, "The same text here, once more and again.", "en", "a", 1, "x", "y", "z"),
    (2, "the same TEXT here, once more and again.", "en", "a", 1, None, None, None),
    (2, "the same TEXT here, once more and again.", "en", "a", 1, None, None, None),
    (3, None, "en", None, None, None, None, None),
    (4, "", None, "a", 0, None, None, None),
    (None, "A text without an id, but with words.", "en", "a", 1, None, None, None),
    (5, "Ein längerer Text über Öl und Bäume. " * 4000, "de", "a", 1, None, None, None),
    (6, " \n\t \r\n ", "en", "a", 1, None, None, None),
    (7, "x" * 50_000, "en", "a", 1, None, None, None),
    (8, "12,5 % !!! ??? 中文 \U0001f600 \x00\x01", "en", "a", 1, None, None, None),
    (9, "one\n\n\ntwo words\n", "en", "a", 1, None, None, None),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
