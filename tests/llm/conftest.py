import pytest
from pyspark.sql import functions as F

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "!!! ... 123", "en", "b", 9), (5, "one two three", "en", "b", 13),
    (6, "one two three", "en", "b", 13), (7, "Ünïcode élan 漢字 wörter und mehr", "de", "b", 30), (8, "x" * 50_000, "en", "c", 50_000),
    (9, "word " * 20_000, "en", "c", 100_000), (9, "word " * 20_000, "en", "c", 100_000), (None, "no id at all", "en", "c", 12), (10, "<|begin|> </s> \\ <|end|>", "en", "c", 24),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns that clash with results."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({"n_words": F.lit("mine"), "score": F.lit("mine"), "kept": F.lit("mine"), "spans": F.lit("mine"), "id": F.lit("mine")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
