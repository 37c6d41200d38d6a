import random

import pytest
from pyspark.sql import functions as F

COMMON = ["the", "of", "and", "to", "in"]


def prose(rng, n, vocabulary=4000):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, wordless and very long texts, repeated rows, shared ids, extra columns with names that operators use inside."""
    rng = random.Random(11)
    long = prose(rng, 30_000)
    rows = [(1, None), (2, ""), (3, "!!! ???"), (4, "one"), (5, "one two"), (6, long), (7, long), (8, "same text here"), (8, "same text here"), (None, "no id"), (None, None), (9, "x\n\n\ny"), (10, "été À Ñandú 東京"), (11, prose(rng, 60))]
    df = spark.createDataFrame([(i, t, "en" if t and i != 4 else None, None if i == 2 else "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = "digest node row bucket words text_sha256 kept score label seed id top copies run key line factor topic weight bag root hash".split()
    return df.withColumns({c: F.lit("extra") for c in extra})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with exact copies, near copies in chains, shared passages, and one very large group."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(3, 160)) for _ in range(150)]
    base = prose(rng, 120).split()
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(copy))
        if rng.random() < 0.2:
            base = copy
    passage = prose(rng, 55)
    texts += [f"{prose(rng, 10)} {passage} {prose(rng, 20)}" for _ in range(40)]
    texts += [texts[k] for k in range(0, 250, 9)] + [texts[0]] * 40
    return spark.createDataFrame([(k, t, rng.choice(["en", "fr"]), f"s{min(k % 7, 3)}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(6)
