import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like helpers."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", None, 3),
        (5, "The same text again and again, said twice.", "en", "b", 1), (5, "The same text again and again, said twice.", "en", "b", 1),
        (6, "the SAME text again and again, said twice.", None, "b", 1), (None, "A row without an id but with words.", "en", "b", 1),
        (None, "A row without an id but with words.", "en", "b", 1), (7, long, "en", "c", len(long)), (8, long + " more", "en", "c", 1),
        (9, "zürich 東京 naïve \U0001f600", "de", "é", 1), (9, "another text under the same id", "de", "é", 1),
    ]
    frame = spark.createDataFrame(rows, DOC).repartition(3)
    from pyspark.sql import functions as F

    for name in ("id", "size", "digest", "score", "copies", "row", "nth", "fp", "_row", "_digest", "_nth", "_text", "key", "raw", "h", "label"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
