import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    base = [(i, f"the quick brown fox number {i} jumps over the lazy dog again and again by the river " * (1 + i % 5), ("en", "fr")[i % 2], f"s{i % 3}") for i in range(60)]
    base += [(60, None, "en", "s0"), (61, "", None, None), (62, " \t\n", "en", None), (63, "x " * 30_000, "en", "s1"), (None, "no id at all here", "en", "s1"), (None, None, None, None), (64, "é ß Ünï " * 40, "fr", "s2"), (5, base[5][1], "fr", "s2"), (5, base[5][1], "fr", "s2"), (65, "12 34 !! ??", None, "s0")]
    rows = [(*r, len(r[1] or ""), 7, "h", 1.5) for r in base]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, hash string, fp double")
