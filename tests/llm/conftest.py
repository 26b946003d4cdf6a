import random

import pytest

WORDS = "the of and a table river stone winter letter market engine paper copper orange window silver garden morning copy bridge".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, very long, repeated and near-equal texts, ties, all in one list."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    long = prose(2, 60_000)
    return [
        None, "", " \n\t ", "one", "one", "ONE", "two words", base, base, base.upper(), near, near + " tail", prose(3, 200), long, long, "é" * 40_000,
        "a\nb\na\n\n\nb\n", "### *** $$$ %%% &&& <>", prose(4, 80) + "\n" + prose(4, 80), "x" * 5000, "你好 世界 🙂", 'token = "24be64439e3e49cf46b2d7c90f3602a3"',
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with columns whose names the operators use inside, and one row twice."""
    rows = [(i, t, "en", "src", len(t or ""), -1, "k", 0.5) for i, t in enumerate(odd_texts)]
    rows.append(rows[7])
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, rank string, kept double"
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
