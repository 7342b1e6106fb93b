import random

import pytest

WORDS = "the of and river stone cloud paper light under table green window market garden silver engine".split()


@pytest.fixture(scope="session")
def prose():
    """Seeded word sequences."""
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def docs(spark, prose):
    """Odd rows: nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, prose(1, 60), "en", "a", 1, "x"), (2, prose(1, 60), "en", "a", 1, "x"), (3, "", "en", "b", 0, None), (4, None, None, None, None, None),
            (5, prose(5, 20000), "de", "b", 1, "x"), (6, "... !!! 123", "de", None, 1, "x"), (None, prose(7, 30), "de", "a", 1, "x"),
            (8, prose(8, 40), None, "a", 1, "x"), (8, prose(8, 40), None, "a", 1, "x"), (9, "one", "fr", "c", 1, "x"),
            (10, "\n\n \t\n", "fr", "c", 1, "x"), (11, "Released under the MIT License.\n" + prose(11, 12), "fr", "c", 1, "x")]
    # size, fp, host and key clash with names the operators use inside or return
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, fp string").selectExpr(
        "*", "fp as host", "fp as key", "fp as n_chars", "fp as target")
