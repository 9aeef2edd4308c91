"""Small documents with the awkward cases every operator must take."""

from __future__ import annotations

import random

WORDS = "the of and to in he was on with as bright river stone cloud amber falcon meadow copper lantern harbor willow ember".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(1000)}"
    return " ".join(words)


def documents(spark, rows):
    """(doc_id, text) rows with more columns, some named like the operators' own."""
    full = [(i, t, "en", "s", len(t) if t is not None else None, "x", 1, "k", 0.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key string, score double")


def awkward(spark):
    long = prose(1, 30_000)
    rows = [(1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, " \n\t "), (None, prose(2, 50)), (None, None),
            (6, "one"), (7, long), (8, edited(prose(1, 120), 3, 1)), (9, "ümläut 日本 \U0001f600 " + prose(5, 30)), (10, prose(6, 80))]
    return documents(spark, rows), rows
