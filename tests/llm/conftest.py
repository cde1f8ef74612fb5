import pytest

LONG = " ".join(f"word{i % 977} x{i * i % 1013}" for i in range(30_000))
COPY = "One two three four five six seven eight nine ten, eleven twelve thirteen. " * 12
#: Null, empty and blank texts, repeated rows, ties, a very long text and a null id column elsewhere.
EDGES = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "de", "b"), (4, "ab", "en", "a"), (5, COPY, "en", "a"), (5, COPY, "en", "a"), (6, COPY, "fr", None),
    (7, COPY + "tail", "fr", "b"), (8, LONG, "es", "a"), (9, LONG + " end", "es", "a"), (10, "ÄÖ ü 漢字 🙂 <|endoftext|>", None, "c"), (11, "...!!! 123", "en", "c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with columns whose names clash with names that operators use inside."""
    rows = [(*r, "x", 1.5, 7, "k", 3) for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, score double, part int, key string, size long").repartition(3)


@pytest.fixture(scope="session")
def no_rows(edges):
    return edges.limit(0)
