import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs string, label int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "Of", "and", "stone,", "étude", "7", "river", "ß", "x-ray", "naïve", "oak.", "\n"]) + rng.choice(["", "a", "Er"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "one"), (3, prose(rng, 9000)), (4, "same text here for all of us"), (5, "same text here for all of us"), (6, " \n\t "), (None, "no id"), (8, "日本語 テキスト 🙂 <|endoftext|> it's 12.5%")]
    rows += [(10 + i, prose(rng, rng.randrange(1, 200))) for i in range(40)]
    rows += [rows[4], rows[20]]
    return spark.createDataFrame([(i, t, None, "s", None, "r", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
