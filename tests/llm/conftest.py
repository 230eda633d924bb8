import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with names of our own."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, "a b  c", "en", "s1"), (2, "a b c", "en", "s1"), (2, "a b c", "en", "s1"), (3, None, None, None),
        (4, "", "en", "s2"), (None, "a\tb c", "en", "s2"), (5, " \n\t ", "fr", None), (6, long, "en", "s1"),
        (7, long + " tail", "en", "s3"), (8, "one", "en", "s1"), (9, "ONE", "en", "s1"), (None, None, None, "s1"), (10, "x" * 50_000, "en", "s2"),
    ]
    return spark.createDataFrame([(i, t, la, s, 0, "x") for i, t, la, s in rows], DOCS + ", kept string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
