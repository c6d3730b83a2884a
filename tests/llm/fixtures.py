"""Small document tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "te", "su") for b in ("ra", "ne", "vi", "do", "pu", "s", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that the operators use inside.
CLASH = "node long, key string, doc int, row string, _row string, items string, n long, tie long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    """Texts of many lengths, copies, near copies, shared passages and lines, odd characters, null and empty."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 70), sentence(rng, 9)
    texts: list[str | None] = []
    for k in range(n):
        t = "\n".join(sentence(rng, rng.choice([3, 6, 12, 40])) for _ in range(rng.choice([1, 2, 5, 12])))
        if k % 5 == 0:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if k % 4 == 1:
            t += "\n" + line + rng.choice(["", "!", " x"]) + "\n" + sentence(rng, 20)
        texts.append(t)
    for k in range(0, 12):
        words = texts[20 + k % 4].split(" ")
        if k % 3:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " \n\t ", "one", "one two three four", "É ÉCOLE ßtraße naïve 日本語 \U0001f600", sentence(rng, 6000), "a\r\nb\x0bc\x0cd\te", "#*$ %&| <> #*$", texts[3], texts[3]]
    rows = [(k, t, ["en", "de", None][k % 3], "web", None if t is None else len(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def with_clashes(spark, rows):
    """The rows with columns named like the operators' own, one repeated row, one null id and one equal id."""
    wide = [(*r, 1, "k", 2, "r", "s", "i", 3, 4) for r in rows]
    wide += [wide[0], (None, *wide[1][1:]), (wide[2][0], *wide[3][1:])]
    return spark.createDataFrame(wide, f"{SCHEMA}, {CLASH}")
