import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Nulls in every column, empty and blank texts, ties, repeated rows, odd white space, a long text.
HARD = [
    (5, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57), (3, None, "en", "a", 0), (4, "", "en", None, 0),
    (None, "text without an id is here too", None, "b", 30), (7, "same words here for all of us now", "de", "b", None),
    (8, "same words here for all of us now", "de", "b", 33), (8, "same words here for all of us now", "de", "b", 33),
    (9, " \n\t ", "fr", "c", 4), (10, "ünï çødé 中文 😀 <|endoftext|> done's  it x\x1c", "fr", "c", 9), (11, "word " * 30000, "en", "a", 150000),
    (12, "mail a.b@c.org from 10.0.0.1, card 4041894974608795 or +1 (555) 555-2485", "en", "a", 70),
    (13, "Released under the MIT License. CC BY-NC 4.0, Apache License, Version 2.0!", "en", "a", 70), (-2, "x", "en", "a", 1),
]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text or "") of the hard rows."""
    return [(r[0], r[1] or "") for r in HARD]


@pytest.fixture(scope="session")
def clashing(hard):
    """The hard rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("n_words", "score", "kept", "bucket", "window", "part", "label", "rep", "key", "at", "start", "place", "rank", "size")
    return hard.select("*", *(F.lit("theirs").alias(n) for n in names))
