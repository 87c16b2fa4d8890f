import random

import pytest

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_texts(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text) with copies, near copies, blanks, nulls, long texts, repeated rows and strange characters."""
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Éa", "straße", "x", "Tion", "😀", "data", "mail@b.co", "12", "re***"] + [f"w{i}" for i in range(300)]
    line = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    shared = [line(30) for _ in range(4)]
    rows = []
    for i in range(n):
        lines = [line(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(shared))
        rows.append((i, "\n".join(lines)))
    base = " ".join(f"v{i}" for i in range(200))
    rows += [(n + i, base.replace(f"v{7 * i}", "changed")) for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one two"), (205, "one  two"), (206, rows[0][1]), (206, rows[0][1]),
             (None, rows[0][1]), (None, "alone here"), (207, line(20_000)), (208, "a\u0001b\x0bc"), (209, "\n".join(["again and again"] * 50)), (203, "another text")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The texts as a table with clashing column names."""
    rows = [(d, t, None, "k", 1.0, "n") for d, t in odd_texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, key string, score double, n string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")
