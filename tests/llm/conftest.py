import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, length long, tie long, mix_words string, head boolean, l string, n int"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents out of (doc_id, text[, lang, source]), with columns that clash with names the
    operators use."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, "en", "s")[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, len(text) if text else None, 1, 2, 3, "x", True, "y", 4))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (6, words), (7, words + " end"), (None, "no id"), (8, "ünï cödé \U0001f600 " * 20),
        (9, "a b c d e f g"), (10, None, None, None), (-3, "negative id"), (11, "x" * 50_000),
    ]
