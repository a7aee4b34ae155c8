import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key string, _drop string, host string, score double, path string, component_id long, _gone long, _source int"


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "er", "on", "ti", "an", "é", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows():
    """Nulls in every column, empty, blank, short, very long and repeated texts, equal ids, and columns that clash with working names."""
    rng = random.Random(5)
    base = words(rng, 60)
    texts = [
        None, "", "   \n\t ", "One", "two words", "one two three four", "A b c d e", base, base, base.upper(), base.replace("the", "tha", 1), base + " tail",
        words(rng, 6000), "x" * 50_000, "Released under the MIT License.", "Menu\nHome\n" + base, "Menu\nHome\nother text here", "Menu\nHome\n", "a\u00a0b\u2003c d e f g", "\u0000 odd \u2581 marks \U0001f600 here now", "| a | b |\n" * 30,
    ]
    out = [(i, t, "en" if i % 3 else "fr", "s1" if i % 2 else "s2", len(t) if t is not None else None) for i, t in enumerate(texts)]
    out += [(7, base, "en", "s1", 5), (7, base, "en", "s1", 5), (None, base, "en", "s1", 5), (50, None, None, None, None), (51, words(rng, 40), None, None, None)]
    return [(*r, "z", 1, "k", "d", "h", 0.5, "p/q", 9, 9, 3) for r in out]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
