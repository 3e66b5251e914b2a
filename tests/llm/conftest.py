import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, line, "en", "a", 1), (1, line, "en", "a", 1), (2, line, None, "a", 1), (3, "", "en", "b", 0), (4, None, "en", None, None),
        (None, line, "en", "b", 2), (None, None, None, None, None), (5, long, "de", "a", 9), (6, " \n\t \r\n", "fr", "b", 3), (7, "short", "en", "c", 5),
        (8, f"{line}\n{line}\n{line}", "en", "c", 7), (9, "ü€😀 " * 70, "es", "c", 8), (8, "another text for the same id", "en", "c", 7),
    ]
    clash = ["score", "predicted", "kept", "n_words", "fp", "component_id", "n_lines", "size", "copies", "taken", "section", "item_id", "slot", "doc", "v", "leaf"]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in clash)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
