import pytest

#: Rows with nulls, empty and very long texts, repeats, and columns whose names the operators use inside.
ODD = [
    (1, "", "en", "a", 0, "x"),
    (2, None, None, None, None, "x"),
    (None, "A text of some words, without an id. It has two sentences.", "en", "a", 3, "x"),
    (3, "one two", "en", "a", 7, "x"),
    (4, "Ein Satz. " * 4000, "de", "b", 40000, "x"),
    (4, "Ein Satz. " * 4000, "de", "b", 40000, "x"),
    (5, " \n\t \n", "de", "b", 5, "x"),
    (6, "éèê ñ ß 漢字 \U0001F600 mixed\r\nline", "fr", "b", 20, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string"


@pytest.fixture()
def odd(spark):
    def make(clash="key"):
        return spark.createDataFrame(ODD, SCHEMA.format(clash))
    return make
