import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, id long, name string, slot int, _row string, n_shingles int, bucket int, path string, "
    "row_number int, kept boolean, g string, size double"
)
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
PROSE = "the quick brown fox jumps over the lazy dog while the old grey cat sleeps near the warm stove and dreams of fish in the deep blue sea"
VARIANT = PROSE.replace("quick", "swift")
TEXTS = [
    (1, PROSE, "en", "a"), (2, PROSE.replace(" ", "  \t", 3), "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", "b"),
    (1, PROSE, "en", "a"), (None, "x y", "de", None), (None, "x y", "de", None), (None, None, None, None), (6, LONG, "en", "c"), (7, LONG, "en", "c"),
    (8, LONG + " end", "en", "c"), (9, VARIANT, "en", "b"), (10, PROSE.upper(), "en", "b"), (11, "one two", "en", "a"), (12, "one two", "en", "a"),
    (13, "one two three four five", "fr", "a"), (14, "12345 67 !!", "fr", "b"), (1, "other text under a used id", "en", "b"), (15, "ſK tokeN", "de", "b"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with names used inside."""
    rows = [(*r, 5, "n", 1, "r", 2, 3, "p", 4, True, "g", 1.5) for r in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
