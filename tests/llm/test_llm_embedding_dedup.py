from __future__ import annotations

import numpy as np
import pytest

from snaplevel.llm import embedding_dedup


def brute(rows, threshold=0.98):
    good = []
    for k, (_, v, label) in enumerate(rows):
        ok = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float64) if ok else None)
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            x, y = good[a], good[b]
            if x is None or y is None or rows[a][2] != rows[b][2] or len(x) != len(y):
                continue
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[k][0], len(links[k]), least, rows[k][0] == least))
    return sorted(out, key=str)


def table(spark, rows):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "y") for i, v, label in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, id string, size string").repartition(4)


def found(spark, rows, **options):
    got = embedding_dedup.near_duplicates(table(spark, rows), **options)
    return sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(seed, n=240, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=size) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, np.float32(v * rng.choice([1.0, 100.0])).tolist(), int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_equals_comparing_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = clustered(tile)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # a hot group of copies
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0),
        (8, [1.0, float("nan"), 3.0], 0), (9, [float("inf"), 2.0, 3.0], 0), (10, [1.0, 2.0], 0), (11, [2.0, 4.0, 6.0], 0), (None, v, 0),
        (None, [5.0, -1.0, 0.0], 1), (12, [1e-30, 2e-30, 3e-30], 0), (13, [-0.0, 1.0, 0.0], 1), (14, [0.0, 1.0, 0.0], 1), (15, [3e38, 3e38, 3e38], 2), (16, [1.0, 1.0, 1.0], 2),
    ]
    assert found(spark, rows) == brute(rows)


def test_stops_early_without_losing_a_pair():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 32))
    b = a[rng.permutation(60)] + rng.normal(size=(60, 32)) * 0.1
    cosine = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    for threshold in (0.9, 0.98, 0.995):
        i, j = embedding_dedup.linked(a, b, None, threshold)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(cosine >= threshold)), strict=True))


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None)]) == [(1, 0, 1, True)]
