import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names
    the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    plain = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, plain, "en", "s", 1, "a", 0.5), (1, plain, "en", "s", 1, "a", 0.5), (2, plain, None, None, None, None, None),
        (3, None, "en", "s", None, "b", 0.5), (4, "", "en", "s", 0, "b", 0.5), (5, long, "en", "s", 9, "b", 0.5),
        (None, plain, "en", "s", 1, "c", 0.5), (None, None, None, None, None, None, None), (6, " \n\t ", "de", "t", 1, "d", 0.5),
        (7, "É漢字 😀 naïve x", "fr", "t", 1, "d", 0.5),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, keep string, key double",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
