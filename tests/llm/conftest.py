import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, an empty and a long text, ties, repeated rows, and columns whose names clash with those of the operators."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (None, "alone here"), (6, "Tie a b c"), (6, "Tie a b c"),
            (7, "mail ann.lee@mail.example.com or +1 (656) 555-7911 now"), (8, "é漢 " * 4000), (9, "x")]
    return spark.createDataFrame([(d, t, "en", "s", 1, -1, 2.0, b"k", "c") for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, start long, score double, key binary, class string")
