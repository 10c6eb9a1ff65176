import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, very long, repeated rows, ties, and columns with clashing names."""
    base = words(60, 1)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base + " tail", "en", "a", 1),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \n\t ", "en", "a", 4),
        (7, "### !!! 123", "en", "b", 11),
        (8, words(30_000, 2), "de", "b", 1),
        (9, "Ünïcödé 中文   é \x00 end", "fr", "b", 1),
        (10, "a", "en", "c", 1),
        (10, "a", "en", "c", 1),
        (None, "no id here at all", "en", "c", 1),
        (11, words(45, 9) + "\n" + words(25, 1), "en", "c", 1),
    ]
    df = spark.createDataFrame([(*r, "x", 0.5, 3) for r in rows], DOCS + ", gram string, n double, row int")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
