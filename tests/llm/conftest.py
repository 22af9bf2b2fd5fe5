import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ser", "vo", "pra", "ne") for b in ("n", "ra", "st", "lim", "do", "que", "x", "ber", "fo")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts that every operator has to take: null, empty, blank, one word, repeated rows, very long, no spaces, symbols."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    return [(1, None), (2, ""), (3, " \n\t\n "), (4, "word"), (5, "same text twice here"), (5, "same text twice here"), (6, long), (7, "x" * 50_000),
            (8, "#$%&|<>" * 30), (9, "Überall größe\nÜberall größe\nÜberall größe"), (10, "\x00 odd \x1c\x85 é"), (None, "a row without an id"),
            (11, "12 " * 3000), (12, long)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names operators use themselves."""
    rows = [(i, t, None if k % 3 else "en", "src" if k % 4 else None, k, float(k), [k], "z") for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words double, spans array<int>, sequence_id string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
