"""Hard negatives equal a plain search over all rows; the intervals hold every score."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplevel.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label string, row string, size string, score string, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(4)


def brute(rows, scale=256, n=5, anchor=lambda i: i is not None and i % 10 == 0, band=(80, 100, 100)):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(scale * float(np.float32(x))) for x in v]
        if sum(x * x for x in whole) < hn.LONGEST:
            good.append((i, whole, label))
    low, high, of = band
    first = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:n]
    out = []
    for a, (i, v, label) in enumerate(good):
        if not anchor(i):
            continue
        scores = [
            (sum(x * y for x, y in zip(v, w, strict=True)), j, other == label)
            for b, (j, w, other) in enumerate(good)
            if a != b and len(w) == len(v)
        ]
        for p, j, _ in first([s for s in scores if s[2]]):
            inside = [s for s in scores if not s[2] and low * p <= of * s[0] <= high * p]
            out += [(i, j, k, m, p, s) for k, (s, m, _) in enumerate(first(inside), 1)]
    return sorted(out, key=str)


def vectors(n=400, size=24, labels=3):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, size))
    rows = []
    for k in range(n):
        v = centres[rng.integers(12)] * 0.2 + rng.normal(size=size) * 0.05
        rows.append((k, [float(np.float32(x)) for x in v], f"l{rng.integers(labels)}" if k % 3 else "l0"))
    return rows


def odd_rows():
    rows = vectors()
    v = rows[0][1]
    rows += [(500 + 10 * k, v, "l0") for k in range(8)] + [(700 + k, v, "l1") for k in range(8)]  # ties
    rows += [(800, v, "l2")] * 3 + [(801, v, "l1")] * 2  # repeated rows
    rows += [(900, None, "l0"), (910, v, None), (920, [*v[:-1], None], "l0"), (930, [math.nan, *v[1:]], "l0"), (940, [math.inf, *v[1:]], "l0")]
    rows += [(None, v, "l1"), (None, v, "l0"), (950, [0.0] * 24, "l0"), (951, [0.0] * 24, "l0"), (952, [0.0] * 24, "l2")]
    rows += [(960, [], "l0"), (961, [], "l0"), (962, [], "l1"), (970, [1.0, 2.0, 3.0], "l0"), (971, [1.0, 2.5, 3.0], "l0"), (972, [1.0, 2.2, 2.9], "l1")]
    rows += [(980, [-1e30] * 24, "l0"), (990, [40_000.0] * 24, "l0"), (991, [40_000.0] * 24, "l0"), (992, [39_000.0] * 24, "l1")]
    return rows


@pytest.mark.parametrize("block,pack,step", [(1 << 19, 1 << 17, 128), (400, 100, 2)])
def test_equals_plain_search(spark, monkeypatch, block, pack, step):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "PACK", pack)
    monkeypatch.setattr(hn, "STEP", step)
    rows = odd_rows()
    got = hn.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert len(got) > 300


def test_other_numbers_and_types(spark):
    rows = vectors(150, 5)
    df = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    got = hn.mine(df, F.col("vec_id") % 25 == 0, scale=10, positives=2, negatives=3, band=(1, 3, 2)).collect()
    want = brute(rows, 10, 5, lambda i: i % 25 == 0, (1, 3, 2))
    # Fewer of each are the first ones of each.
    order = {}
    for r in want:
        order.setdefault(r[0], {})[r[1]] = r[4]
    first = {(a, p) for a, ps in order.items() for p, _ in sorted(ps.items(), key=lambda x: (-x[1], x[0]))[:2]}
    for r in got:
        assert r["rank"] <= 3 and tuple(r) in want
    assert {(r["anchor_id"], r["positive_id"]) for r in got} <= {(r[0], r[1]) for r in want}
    assert first & {(r["anchor_id"], r["positive_id"]) for r in got}


def test_empty(spark):
    df = frame(spark, [])
    assert hn.mine(df, F.col("vec_id") % 10 == 0).collect() == []
    assert hn.mine(frame(spark, [(1, [1.0], "a"), (2, [1.0], "b")]), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("size", [1, 3, 24, 64, 100])
def test_intervals_hold_all_scores(size):
    rng = np.random.default_rng(size)
    whole = np.floor(256 * rng.normal(size=(300, size)) * rng.choice([1e-2, 1, 1e4], (300, 1))).astype(np.int32)
    whole[:40] = whole[40:80] + rng.integers(-1, 2, (40, size))
    whole[0] = 0
    whole[1] = 7
    codes, align, lengths = hn.codes_of(whole)
    estimate, lower, upper = hn.intervals(whole[:100], codes, align)
    scale = np.maximum(lengths[:100, None] * lengths[None, :], 1)
    cosine = (whole[:100].astype(float) @ whole.astype(float).T) / scale
    inside = (lower <= cosine) & (cosine <= upper)
    inside[lengths[:100] == 0] = True
    inside[:, lengths == 0] = True
    assert inside.all()
    if size >= 24:
        assert (upper < 0.8).mean() > 0.4 and np.abs(estimate - cosine)[lengths[:100] > 0].mean() < 0.3


def test_rotation_keeps_lengths_and_products():
    x = np.random.default_rng(1).normal(size=(50, 24))
    turned = hn.rotated(x)
    assert np.allclose(turned @ turned.T, x @ x.T)
