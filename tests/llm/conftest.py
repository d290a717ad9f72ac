"""Small fixtures with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    words = " ".join(f"word{i % 97}" for i in range(40_000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, "one two three", "en", "a", 13),
        (3, "one two three", "en", "a", 13),
        (4, "One  two\tthree", None, "b", 14),
        (None, "one two three four five six seven", "de", "b", None),
        (None, None, None, None, None),
        (5, words, "en", "c", len(words)),
        (6, words + " end", "en", "c", len(words) + 4),
        (7, " \n\t ", "en", "c", 4),
        (8, "é ñ ß <|endoftext|>   　x  y \n\n z don't I'll, 12,5", "fr", "c", 40),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The odd rows with further columns, named as the operators name things inside."""
    from pyspark.sql import functions as F

    names = ["score", "toxicity", "node", "part", "rank", "label", "y", "size", "target", "copies", "rate", "keys", "row_hash", "text_hash", "m", "d"]
    return odd_docs.select("*", *[F.lit(1).alias(n) for n in names])
