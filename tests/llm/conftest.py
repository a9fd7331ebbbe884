import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000)) + "\n" + "x" * 200_000
    some = "Some plain words stand here, and they go on for a while. " * 3
    rows = [
        (1, some, "en", "a", 5),
        (1, some, "en", "a", 5),
        (2, some, "en", "b", None),
        (3, None, "en", "a", 0),
        (4, "", None, "a", 0),
        (None, some, "en", None, 1),
        (None, None, None, None, None),
        (5, long, "de", "c", len(long)),
        (6, long, "de", "d", len(long)),
        (7, " \t\n\r ", "en", "a", 5),
        (8, "é\u2581ß 👩‍👩‍👧 \x00 \ufeff", "fr", "a", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = ["id", "record", "row", "r", "tk", "rid", "key", "keys", "gone", "hit", "lines", "counts", "score", "shard", "slot", "bucket", "u", "n_words", "comp", "_gone", "_id", "top"]
    for i, c in enumerate(extra):
        df = df.withColumn(c, df.doc_id * 0 + i)
    return df.withColumn("with.dot", df.text).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
