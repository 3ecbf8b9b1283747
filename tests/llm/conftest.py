import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words_ string, spans_ string, row_ long, fp long, doc long, score string, kept string"


def sentence(r, n):
    return " ".join(r.choice(["the", "of", "and", "stone", "river", "walks", "over", "light", "mouse", "seven", "green", "under"]) for _ in range(n))


def messy():
    """Nulls, empty and long texts, ties, repeated rows."""
    r = random.Random(4)
    shared = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", " \n\t ", "one", "a b c", "12 34 !!", sentence(r, 40), sentence(r, 40) + " " + shared, shared, shared + " tail", "x " * 3000, "é" * 5000, sentence(r, 8000), "mail me@site.org or +49 (030) 1234567 now", 'token = "abcdef0123456789abcdef0123456789"', sentence(r, 30) + "\n" + sentence(r, 30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 100, t) for k, t in enumerate(texts)]
    rows += [(6, texts[6]), (6, texts[6])]
    return [(i, t, None if i % 5 == 0 else ("en" if i % 2 else "de"), "s", len(t or ""), "x", "y", 1, 2, 3, "s", "k") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
