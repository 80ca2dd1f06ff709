import random

import pytest


@pytest.fixture()
def documents(spark):
    """Nulls, empty and long texts, repeated rows, near copies, shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(120)
    rows = [(i, prose(rng.randint(1, 120))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t"), (103, "one two"), (104, "One  two"), (105, "x" * 900), (105, "x" * 900)]
    rows += [(200 + i, f"{prose(30)} {passage} {prose(20)}") for i in range(12)]
    base = prose(150).split()
    for i in range(40):  # near copies, each with its own changes
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words).upper()
        rows.append((300 + i, " ".join(own)))
    rows += [(400 + i, "The same text.\nTwice  over.") for i in range(9)]
    rows += [(500, "ÀÉ ß 한글 🙂 \\### </turn>" * 30), (501, prose(9000)), (None, prose(50))]
    return rows
