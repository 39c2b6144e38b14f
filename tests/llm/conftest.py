import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id long, row_key string, score string, size long"
WORDS = [f"w{i}{'abcdefgh'[i % 8] * (i % 5)}" for i in range(400)]


def some_text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def make_docs(seed=1):
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and long texts, repeated ids, blanks and tabs."""
    rnd = random.Random(seed)
    base = some_text(rnd, 300)
    passage = some_text(rnd, 70)
    docs = [(i, some_text(rnd, rnd.randint(1, 200))) for i in range(40)]
    docs += [(100 + i, base) for i in range(5)]
    for i in range(12):
        w = base.split(" ")
        for _ in range(rnd.randint(1, 8)):
            w[rnd.randrange(len(w))] = "changed" + str(rnd.randrange(99))
        docs.append((200 + i, " ".join(w)))
    docs += [(300 + i, f"{some_text(rnd, 40)}\n{passage}\t{some_text(rnd, 30)}") for i in range(6)]
    docs += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one"), (405, "One two"), (406, "a b c d"), (407, "été ñandú " * 30), (408, "x " * 900), (409, "x " * 1500)]
    docs += [(500, some_text(rnd, 20000)), (501, "word" * 5000)]
    docs += [(None, base), (None, None), (100, base), (3, some_text(rnd, 60))]
    return docs


@pytest.fixture(scope="session")
def docs(spark):
    """The fixture as a table with columns whose names clash with those the operators use."""
    rows = [(d, t, "en", f"s{(d or 0) % 3}" if d != 7 else None, None, "k", 1, "r", "s", 5) for d, t in make_docs()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
