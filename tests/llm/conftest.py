import pytest

WORDS = [f"w{i:03d}" for i in range(400)]


def body(start, n=60):
    return " ".join(WORDS[(start * 7 + 3 * i + i * i % 11) % 400] for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, an empty and a very long text, ties, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, body(1), "a", 0.5, "x"), (2, body(1), "a", None, "x"), (3, body(1) + " end", None, 0.1, "y"), (4, body(2), "b", 0.2, None), (5, "", "b", 0.2, "z"), (6, None, None, None, None),
        (7, "  \n\t ", "c", 0.0, "z"), (8, "one two", "c", 0.0, "z"), (9, "ONE two", "c", 0.0, "z"), (10, " ".join(body(k) for k in range(400)), "c", 1.0, "z"),
        (11, body(5), "d", 1.0, "q"), (11, body(5), "d", 1.0, "q"), (None, body(9), "d", 1.0, "q"), (12, "éÀ ünï 中文 😀  x▁y <|endoftext|> <s>  two  spaces ", "e", 1.0, "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, component_id string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
