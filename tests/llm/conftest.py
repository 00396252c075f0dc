import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, label string, start string, size string"


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text) or (doc_id, text, source) -> documents with further columns whose names operators use inside."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", None, "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd():
    """Texts every operator must bear: NULL, empty, blank, long, repeated rows, ties, other scripts."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long.upper()), (6, "Ünï çødé ß ΑΣ " * 40), (7, "same text here"), (7, "same text here"),
        (8, "SAME text here"), (9, "one"), (10, "\n\n\n"), (11, "a" * 70_000), (12, "same text here ünd"),
    ]
