from __future__ import annotations

import random
import re

import odd
import pytest

from snaplevel.llm import ngram_join
from snaplevel.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _, _) in enumerate(rows)), key=str)


def found(spark, rows):
    got = ngram_join.near_duplicates(odd.docs(spark, rows))
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)


def test_odd_rows(spark):
    assert found(spark, odd.texts()) == brute(odd.texts())


def families(seed, base=12, copies=14):
    """Texts with more and more changes, and a passage that many of them share."""
    rng = random.Random(seed)
    passage = odd.words(rng, 40, 10_000)
    rows = []
    for _ in range(base):
        start = odd.words(rng, rng.randrange(3, 160), 3000)
        for _ in range(copies):
            text = list(start)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(9999)}"
            if rng.random() < 0.3:
                text[rng.randrange(len(text)) : 0] = passage
            if rng.random() < 0.3:
                text = text[: rng.randrange(1, len(text) + 1)]
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.2 else "\n".join(text), None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"DENSE": 2, "HUBS": 1, "TILE": 4}, {"DENSE": 3, "HUBS": 2, "TILE": 8, "HOT": 20}])
def test_equals_comparing_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = families(len(limits))
    assert found(spark, rows) == brute(rows)


def test_threshold_is_reached_by_equality(spark):
    # 7 n-grams each, 6 in common: 6 / 8; then 5 in common: 5 / 9.
    a = "a b c d e f g h i j k"
    rows = [(1, a, None), (2, a[:-1] + "x", None), (3, a[:-3] + "y z", None)]
    assert found(spark, rows) == brute(rows) == [(1, 7, 1), (2, 7, 1), (3, 7, 3)]


def test_one_of_each(spark):
    docs = odd.docs(spark)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for i, n, c in brute(odd.texts()) if n}
    some = [i for i in ids if i is not None and i not in (300, 301, 302)]
    assert len(some) == len(set(some)) and set(some) == want - {None}
    assert {300, 301, 302} <= set(ids)


def test_empty_table(spark):
    assert ngram_join.near_duplicates(odd.docs(spark, [])).count() == 0
    assert ngram_join.one_of_each(odd.docs(spark, [])).count() == 0


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    want = {x: find(x) for p in links for x in p if find(x) != x}
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
