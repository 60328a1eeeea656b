"""Small tables of documents with every odd case, and brute-force twins of the operators."""

from __future__ import annotations

import random

import pytest
from odd_texts import sentence

@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): copies, near copies, shared lines, nulls, empty and long texts, repeated rows."""
    rng = random.Random(3)
    rows = []
    for i in range(40):
        text = "\n".join(sentence(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])))
    base = sentence(rng, 120)
    words = base.split()
    for i in range(40, 52):
        changed = list(words)
        for _ in range(i % 4):
            changed[rng.randrange(len(changed))] = "zebra"
        rows.append((i, " ".join(changed), "en", "a"))
    rows += [(i, base, "en", "a") for i in range(52, 60)]
    passage = sentence(rng, 55)
    rows += [(i, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 20), "en", "b") for i in range(60, 70)]
    rows += [(70, None, None, None), (71, "", "en", "a"), (72, " \t\n ", "fr", "b"), (73, "!!! 123", "en", None), (74, "x", None, "c"), (75, "é" * 5000 + " " + "漢字" * 300, "fr", "c")]
    rows += [(76, sentence(rng, 6000), "en", "a"), (77, "a" * 3000, "en", "a"), (78, "ab" * 1500, "en", "a"), (0, rows[0][1], rows[0][2], rows[0][3])]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string").repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
