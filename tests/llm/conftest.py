from __future__ import annotations

import random

import pytest

WORDS = "the of and to in that is was for on be with as by this or an at from".split()


def prose(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") * r.randrange(3)) for _ in range(n))


TEXTS = [None, "", " \n\t ", "one", prose(30, 1), prose(30, 1), prose(700, 2), prose(700, 2) + " more", "a\n" * 40, prose(60, 3) + "\n" + prose(5, 4), prose(60, 3) + ".\nend", "Ünïcödé ß   <|endoftext|> x  y\n\n z　", "x" * 20_000, prose(9000, 5)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, i) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[7], (None, "no id here, only some words to read", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, "
    own = "fp long, word string, length int, label string, _text string, piece int, score double, copy int"
    return spark.createDataFrame([(*r, 1, "w", 2, "l", "t", 3, 0.5, 4) for r in rows], schema + own)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")
