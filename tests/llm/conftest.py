import random

import pytest

WORDS = "the of and to in that was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def docs(spark):
    """Makes a table of documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``."""

    def make(rows, **more):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a") for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars")
        for name, value in more.items():
            df = df.selectExpr("*", f"{value} as `{name}`")
        return df

    return make


def edge_rows(rng):
    """Nulls, empty and white texts, repeated rows, ties and one long text."""
    same = prose(rng, 40)
    return [
        (1, same, "en", "a"), (2, same, "en", "b"), (2, same, "en", "b"), (3, None, "en", None), (4, "", None, "a"),
        (5, " \t\n ", "en", "a"), (None, same, "en", "a"), (None, None, None, None), (7, prose(rng, 300_000), "en", "c"),
        (8, "one", "en", "a"), (9, "one  two", "en", "a"), (10, "one two", "en", "a"), (11, prose(rng, 60), "en", "b"),
    ]
