"""Fixtures of these tests; not a conftest, whose name the other tests import from."""

from __future__ import annotations

import random

import pytest

#: Names that the operators use inside.
EXTRA = ("ids", "n", "key", "draw", "importance", "node", "group", "row", "place", "words", "lines", "rules", "spans", "pii_spans", "full_text", "whole_text", "LABEL")


@pytest.fixture(scope="session")
def as_docs(spark):
    """Documents from (doc_id, text), with further columns whose names clash with inner ones."""

    def build(rows, extra=True, parts=3):
        names = EXTRA if extra else ()
        fields = ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]])
        full = [(i, t, *[f"{n}{i}" for n in names]) for i, t in rows]
        return spark.createDataFrame(full, fields).repartition(parts)

    return build


@pytest.fixture(scope="session")
def messy():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eins", "zwei"]) for _ in range(30_000))
    return [
        (1, "a short text of some words"),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (None, "a short text of some words"),
        (None, None),
        (5, long),
        (6, "a  short\ttext of some words"),
        (7, "é ñ ß 中文 ́ <|endoftext|> İstanbul it's"),
        (7, "é ñ ß 中文 ́ <|endoftext|> İstanbul it's"),
        (7, "another text under the same id"),
        (8, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def folk():
    """Plain documents, near copies of some, and copies."""
    rng = random.Random(11)
    syllables = ["an", "on", "the", "er", "ti", "nd", "re", "ou", "in", "ea"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(60)]
    rows, bases = [], []
    for i in range(120):
        if i % 3 and bases:
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(rng.randint(3, 250))]
            if i % 4 == 0:
                words[len(words) // 2 : len(words) // 2] = passage
            bases.append(words)
        rows.append((1000 - i, " ".join(words)))
    return rows
