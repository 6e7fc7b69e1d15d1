import random

import pytest

WORDS = "alpha beta gamma delta river stone cloud green light north paper house under water seven".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with exact and near copies, shared passages, nulls, blanks and one long text; columns with clashing names."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(3, 220)) for _ in range(60)]
    passage = prose(rng, 60)
    for k in range(25):
        words = texts[k].split()
        words[rng.randrange(len(words))] = "changed"
        texts += [texts[k], " ".join(words), f"{prose(rng, 20)} {passage} {prose(rng, rng.randrange(15))}"]
    texts += [None, "", " \t\n", "one two", "One  TWO", "é", prose(rng, 30_000), "ab" * 400, "x" * 300, "ab" * 150]
    rows = [(i, t, "s", i, 0.5) for i, t in enumerate(texts)] + [(3, texts[3], "s", 3, 0.5), (None, texts[5], "s", 5, 0.5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, score double").repartition(7).cache()
