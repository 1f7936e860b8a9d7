import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "vel", "dor", "pha") for b in ("ran", "sik", "to", "mel", "", "ung")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, empty and long texts, ties, repeated rows, near copies and shared passages."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join(words[:i] + ["zzz"] + words[i + 1 :]) for i in (10, 40, 41, 80)]
    shared = prose(rng, 60)
    texts = [None, "", " \n\t ", "one", "one two", base, base, *near, prose(rng, 3000), shared + "\n" + prose(rng, 40), prose(rng, 30) + "\n" + shared, "ÄÖ ü é\n" + shared, "x" * 5000, "ab " * 900]
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(30)]
    rows = [(i * 7, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[3], (None, "a text without id", None, None, None), (None, None, None, None, None)]


@pytest.fixture
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
