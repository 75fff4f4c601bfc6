"""Awkward documents that every operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, n_tokens string, k string, t string, h1 string, key string, line string, g string"
EXTRA = ("x",) * 8
WORDS = "the of and to river stone lamp über façade naïve señor Straße cloud 42 seven o'clock re-do e.g. ÉCOLE lantern harbour velvet".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randint(0, 999)) * rng.randint(0, 1))
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", "!", "?", "\n", ",\n\n", ".  "])
    return " ".join(out)


def tricky_rows() -> list[tuple]:
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 12, 60, 60, 200, 800)]
    near = base[4].split(" ")
    near[17] = "changed"
    texts = [*base, base[2], base[2], " ".join(near), None, "", "   \n\t ", "one", "a b c d", "x" * 30_000, prose(rng, 20_000), "\n".join(["same line again and again here"] * 5), "tabs\tand odd spaces  \x0b here\x1cnow", "<|endoftext|> is text <|startoftext|>", base[5] + " tail", "symbols #$% ### &&& <|> *** " * 20]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", None)[i % 2], 0 if t is None else len(t), *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[3], "en", "s1", 5, *EXTRA), (None, None, None, None, None, *EXTRA), (-5, base[1], "en", "s1", 1, *EXTRA)]
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(tricky_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return tricky_rows()


@pytest.fixture(scope="session")
def small_documents():
    return "/root/testdata/sf0.001"
