import random

import pytest

SCHEMA = "doc_id long, text string, ids string, kept string, score string, n_lines int, _line_keys int, label string"


def sample_texts():
    """Texts with exact and near copies, shared lines and passages, odd white
    space, empty, null and very long ones."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abdeilmnorstué") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))

    passage, line = prose(70), "All Rights Reserved by the makers of this"
    base, small = prose(160), "one two three four five six seven eight nine ten eleven twelve"
    near = base.split(" ")
    texts = [prose(rng.randint(1, 300)) for _ in range(12)]
    texts += [base, base, " ".join(near[:-1]), " ".join([*near[:80], "changed", *near[81:]]), base.upper()]
    texts += [small, small + " thirteen", "zero " + small, "two words", "two words", "one", "  \t\n ", "", None, None]
    texts += [f"{prose(20)}\n  {line} \n{prose(15)}\n{line.upper()}" for _ in range(4)]
    texts += [f"{prose(30)} {passage} {prose(30)}" for _ in range(3)]
    texts += ["ab " * 400, "x" * 5000, prose(9000), f"{prose(3000)}{passage}", "word's don't\r\n\x0bnext\x0cpage  'll nbsp #*$%&|<>"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return list(enumerate(sample_texts(), start=3))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "i", "k", "s", 1, 2, "l") for i, t in texts], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
