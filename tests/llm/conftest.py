from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, id string, mark int, bucket string, n long, drops string, rule string, n_chars long"


def row(doc_id, text):
    return (doc_id, text, "en", "x", 1, "b", 7, "d", "r", -1)


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared lines and passages, nulls, empty and long texts, repeated rows and ids."""
    r = random.Random(5)
    words = ["".join(r.choice(["ba", "ko", "mé", "ти", "漢", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(60)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = "  A Line That Three Documents Have "
    passage = say(30)
    base = [say(60) for _ in range(6)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(6, base[0]), (7, base[0] + " end"), (8, passage + "\n" + say(20)), (9, say(9) + passage + say(9)), (10, None), (11, ""), (12, None)]
    out += [(i, f"{say(8)}\n{shared.upper() if i % 2 else shared}\n{say(5)}\n{shared}") for i in range(13, 18)]
    out += [(18, "\n" * 5), (19, "a b"), (20, "a b"), (21, " ".join(["long"] * 4000)), (22, "x" * 30000), (23, base[1]), (23, base[1]), (24, say(30)), (24, base[2]), (None, base[3]), (None, "null id"), (25, base[4].replace(" ", "\t ", 1)), (-5, passage), (2**62, say(12))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([row(*x) for x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
