import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def doc_rows(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and a clashing extra column."""
    base = "the quick brown fox jumps over the lazy dog and then it runs away into the deep dark forest "
    rows = [(1, base * 30, "en", "s", 1), (2, base * 30, "en", "s", 1), (3, None, None, None, None),
            (4, "", "en", "s", 0), (5, "Ünïcode wörds äre fine too, ça va?", "fr", "t", 5),
            (6, "!!! 123 --- 456", "en", "t", 9), (1, base * 30, "en", "s", 1),
            (None, "a text without an id", "en", "s", 2), (8, base + "but this one has a new end", "en", "s", 3),
            (9, "word " * 30000, "en", "s", 4), (10, "one", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
