import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(vocab) for _ in range(120))
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 2), (3, base + " tail words here", "en", "b", 3), (4, "", "en", "b", 4), (5, None, None, None, None),
        (6, "   \t\n ", "fr", "c", 6), (7, "one", "fr", "c", 7), (8, "Two  words", "fr", None, 8), (9, long, "de", "a", 9), (10, "x y z " + long[:4000], "de", "a", 10),
        (None, base, "en", "a", 11), (None, None, None, None, None), (12, "é ▁▁ ẞ\x00   日本 😀  ", "es", "d", 12), (12, "é ▁▁ ẞ\x00   日本 😀  ", "es", "d", 12),
        (13, "pre " + base[40:], "es", "d", 13), (13, base, "es", "e", 14), (14, base.upper(), "en", "e", 15),
    ]
    schema = "doc_id long, text string, lang string, source string, rank int"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as size", "'k' as text_key", "2 as component_id", "0 as taken", "'q' as others")
