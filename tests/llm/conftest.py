import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, part string, fp string, word string, label string, media string, h string, class string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and other columns with clashing names."""
    texts = [
        (1, "The cat sat on the mat and looked at the dog.", "en"), (2, None, "en"), (3, "", None), (4, "  \n\t ", "de"), (5, "Der Hund und die Katze sind im Haus und nicht im Garten.", "de"),
        (6, "Der Hund und die Katze sind im Haus und nicht im Garten.", "de"), (6, "Der Hund und die Katze sind im Haus und nicht im Garten.", "de"), (None, "a text without an id", None), (None, None, None),
        (7, "x" * 200_000, "en"), (8, "word " * 60_000, "en"), (9, "ünïcödé 漢字 🎉 \x00 　 end", "fr"), (10, "12345 !!! ???", "en"),
    ]
    rows = [(i, t, lang, None if i == 5 else "s", None, "x", None, "y", "w", None, "m", "h", "c") for i, t, lang in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
