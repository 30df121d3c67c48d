"""Small fixtures with the awkward rows that every text operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _uid long, _id string, host string"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b + c for a in ("ta", "ri", "mo", "ke", "lu") for b in ("na", "ver", "sto", "Bi") for c in ("", "s", "ning", "é")]


def awkward(seed: int = 1, n: int = 40) -> list[tuple]:
    """(doc_id, text, lang, source): plain, null, empty, blank, very long, repeated and near-equal rows."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 200)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c"])) for i in range(n)]
    long = words(rng, 60_000)
    rows += [
        (100, None, "en", "a"), (101, "", "en", "a"), (102, " \n\t ", "en", None), (103, long, "en", "a"), (104, rows[3][1], "fr", "b"),
        (105, rows[3][1] + " x", None, None), (None, rows[4][1], "en", "b"), (None, None, None, None), (106, "one", "en", "c"),
        (107, "two words", "en", "c"), (108, "\u00a0nbsp\u2003wide \U0001f600 emoji \x0b\x0c vt", "en", "c"),
    ]
    rows += [(5, rows[5][1], "en", "a")] * 3 + [(6, "another text for six", "en", "a")]
    return rows


def frame(spark, rows: list[tuple]):
    """With further columns whose names the operators use themselves."""
    full = [(i, t, la, so, None if t is None else len(t), -1, 7, i, "x", "h") for i, t, la, so in rows]
    return spark.createDataFrame(full, DOCS)


def ids_first(rows) -> list:
    return sorted(rows, key=repr)
