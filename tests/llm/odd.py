"""Documents with everything odd at once, and with columns named as the operators name theirs inside."""

from __future__ import annotations

import random

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHING = ["key", "row", "n", "at", "size", "word", "copies", "lines", "hash", "owner", "label", "id", "ids", "score", "rest", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    found = words(rng, n)
    return "".join(w + ("\n" if k % 17 == 16 else ". " if k % 9 == 8 else " ") for k, w in enumerate(found)).strip()


def texts() -> list[tuple]:
    """(doc_id, text, source)"""
    rng = random.Random(5)
    plain = [prose(rng, rng.randrange(20, 120)) for _ in range(40)]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(plain)]
    rows += [(100 + k, plain[0], "s0") for k in range(30)]  # a hot group of copies
    near = plain[1].split(" ")
    rows += [(200 + k, " ".join([*near[:k], "changed", *near[k + 1 :]]), "s1") for k in range(len(near) // 2)]
    rows += [(300, None, "s0"), (301, "", None), (302, " \n\t ", "s2"), (303, "one", "s2"), (304, "One", None)]
    rows += [(None, plain[2], None), (None, None, None), (5, plain[5], "s2"), (5, plain[5], "s2"), (5, plain[6], "s2")]
    rows += [(400, prose(rng, 30_000), "s1"), (401, "x" * 70_000, "s1"), (402, "é中\U0001f600 <|endoftext|> " * 40, "s1")]
    return rows


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", s, len(t) if t is not None else None, *("clash" for _ in CLASHING)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def rows_of(df, *columns):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
