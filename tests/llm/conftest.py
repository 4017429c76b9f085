import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch int, range string, toxic int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, exact and near copies, repeated rows, shared passages, and columns with clashing names."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 200)) for _ in range(30)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 30)}" for _ in range(4)]
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", "\n\t"), texts[2] + " tail", texts[3] + " end"]
    texts += [prose(rng, 20_000, 100_000), "", " \n\t ", None, "a", "a b", "a b c d", "ÄÖ ü é", "12 34 !!", "same " * 300]
    out = [(k, t, ("en", "de", None)[k % 3], "src0", len(t or ""), 3, "x", 1) for k, t in enumerate(texts)]
    return out + [out[5], out[5], (None, texts[6], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
