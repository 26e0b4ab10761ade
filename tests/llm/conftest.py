import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _b int, sig string, extra string"


def awkward_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names operators use inside."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    rows = [
        (1, base + " one two three", "en", "a", 1), (2, base + " one two three", "en", "a", 1), (2, base + " one two three", "en", "a", 1), (3, base + " one two four", "en", "b", 1),
        (4, None, "en", "a", None), (5, "", None, None, 0), (6, "   \n\t ", "fr", "c", 6), (7, long, "en", "a", len(long)), (8, "short text", "de", None, 10), (9, "Émile — ñandú\x00 zero 𝒳 <|endoftext|> end", "fr", "b", 5),
        (None, base + " five six", "en", "a", 3), (None, None, None, None, None), (10, "same\nsame\nsame\nother words here to make a text of more than ten words", "en", "c", 1), (11, long[:2000], "en", "c", 9), (12, "x" * 5000, "en", "d", 5000),
    ]
    return [(*r, 7, "s", "e") for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (8, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
