import random

import pytest

SCHEMA = "doc_id long, text string, lang string, key string, node long, h string, digest string, `drop` string, mark string, own long"


def prose(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


SYLLABLES = "the on an in er re ed ing tion ly st or at es en of and ha".split()


def speech(rng, n):
    """Words of common syllables, which tokenizers fit as they fit a language."""
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rng = random.Random(7)
    long = prose(rng, 30_000)
    plain = prose(rng, 80)
    texts = [
        (1, plain), (1, plain), (2, None), (3, ""), (4, " \n\t \n"), (5, long), (6, plain), (None, plain), (None, None),
        (7, "one two three"), (8, "naïve café — 東京 🙂\r\n\x0b x"), (9, "x" * 50_000), (10, "é" * 3000 + " <|endoftext|> " + "\n" * 500),
    ]
    return [(i, t, None, "k", 1, "h", "d", "r", "m", 2) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
