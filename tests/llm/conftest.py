import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank int"


def prose(rng, words):
    stem = ["the", "of", "and", "in", "is", "a"] + [
        x + y for x in ("ra", "ti", "mo", "lu", "ke", "so") for y in ("ban", "dor", "lim", "sket")]
    return " ".join(rng.choice(stem) + rng.choice(["", "", "a", "er", "ing"]) for _ in range(words))


def edited(rng, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = "edited%d" % rng.randrange(10 ** 6)
    return " ".join(w)


@pytest.fixture(scope="session")
def rows():
    """Nulls in any column, empty, blank and very long texts, ties, copies and a shared passage."""
    rng = random.Random(5)
    base = [prose(rng, rng.choice((60, 90, 150, 300))) for _ in range(60)]
    passage = prose(rng, 70)
    texts = list(base)
    texts += [base[3]] * 6 + [base[4].upper()] + [edited(rng, base[5], 0.01) for _ in range(14)]
    texts += [f"{prose(rng, 80)} {passage}\n{prose(rng, 60)}" for _ in range(4)]
    texts += ["", None, " \t\n ", "one", "one two three", "a b c d e", "x" * 30_000,
              prose(rng, 6000), "ﬁ ▁   é\x00", "The The The The " * 40, "### | $$$ " * 60,
              base[7] + "\nReleased under the MIT License.\n" + base[8]]
    out = [(i, t, [None, "en", "fr"][i % 3], None if i % 7 == 0 else f"s{i % 3 if i % 2 else 0}",
            None, "clash", i) for i, t in enumerate(texts)]
    return [*out, out[9], out[9]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
