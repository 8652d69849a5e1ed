import os

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, key double, range int"

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "The quick  brown fox\njumps over the lazy dog again and again", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " ", "de", None),
    (5, "one two", "en", "b"),
    (5, "one two", "en", "b"),
    (6, "ONE TWO", "en", "b"),
    (None, "one two", None, "b"),
    (7, "12 34 !! 56", "fr", "c"),
    (8, LONG, "en", "a"),
    (9, LONG + " tail", "en", "a"),
    (10, "Ünïcödé 漢字 \U0001f600 <|endoftext|>  two  spaces\t\ttabs \n", "de", "c"),
    (11, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "fr", "d"),
    (12, "a b c d e f g h i j k l m n o p q r s t u v w x y z z", "fr", "d"),
    (-7, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "fr", "d"),
]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents (doc_id, text, lang, source) with further columns whose names clash with inner ones."""

    def build(rows):
        data = [(i, t, la, s, len(t or ""), 1, "x", 0.5, 3) for i, t, la, s in rows]
        return spark.createDataFrame(data, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ROWS).cache()


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(os.path.join(sf, "documents.parquet"))
