import random

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, fp string, spans string, label string, held_out string, row string, id string"


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (doc_id, text), with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * 7) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, ties, repeated rows and ids."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(120)
    near = base.split()
    near[60] = "other"
    long = " ".join(say(50) + ".\n" for _ in range(400))
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, say(3)), (8, say(3)), (9, long), (10, base + ". " + say(80)),
        (None, base), (None, None), (11, say(60)), (11, say(60)), (12, "É ñ 日本 don't <|endoftext|> !?"), (13, "a\nb\na\na b c d\na b c d"), (14, base.upper()), (15, "x" * 5000),
    ]
