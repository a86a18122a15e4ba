"""Sketches count exactly while sets are small, within their bounds beyond, and merge in any order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.operators import sketches


def frame(spark, rows):
    return spark.createDataFrame(rows, "gbifID long, datasetKey string, snapshot_year int").repartition(3)


def exact(rows, years):
    ids, empty = {}, {}
    for i, d, y in rows:
        ids.setdefault((y, d), set())
        if i is None:
            empty[y, d] = empty.get((y, d), 0) + 1
        else:
            ids[y, d].add(i)
    out = {}
    for k, a in enumerate(years):
        for b in years[k + 1 :]:
            for d in {d for y, d in ids if y in (a, b)}:
                old, new = ids.get((a, d), set()), ids.get((b, d), set())
                out[a, b, d] = len(old & new), len(new - old), len(old - new), empty.get((b, d), 0)
    return out


def test_small_sets_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(300) if rng.random() < 0.95 else None, rng.choice(["a", "b", None]), y) for y in (2001, 2002, 2005) for _ in range(400)]
    rows += [(7, "late", 2005), (8, "early", 2001), (None, "none", 2002)]
    got = sketches.changes(sketches.id_sketches(frame(spark, rows)), (2001, 2002, 2005)).collect()
    assert {(r["from_year"], r["to_year"], r[S.DATASET]): (r["kept"], r["new"], r["gone"], r["n_empty"]) for r in got} == exact(rows, (2001, 2002, 2005))
    assert all(r["new_low"] == r["new"] == r["new_high"] for r in got)


def test_large_sets_stay_within_bounds(spark):
    """Sketches of 256 hashes for some 20,000 ids; the bounds hold and are not far off."""
    old = [(k, f"d{k % 8}", 1) for k in range(160_000)]
    new = [(k, f"d{k % 8}", 2) for k in range(40_000, 200_000)]
    got = sketches.changes(sketches.id_sketches(frame(spark, old + new), lg=8), (1, 2), lg=8).collect()
    assert len(got) == 8
    inside = [r["new_low"] <= 5_000 <= r["new_high"] for r in got]
    assert sum(inside) >= 7
    assert all(abs(r["new"] - 5_000) < 3_000 and r["new_high"] - r["new_low"] < 12_000 for r in got)


def test_merging_in_any_order_gives_the_same_counts(spark):
    rows = [(k % 5_000, f"d{k % 13}", 1 + k % 2) for k in range(20_000)]
    parts = sketches.id_sketches(frame(spark, rows), lg=9)
    whole = sketches.changes(sketches.id_sketches(frame(spark, rows), by=(), lg=9), (1, 2), by=(), lg=9).collect()
    for order in ("datasetKey", F.desc("datasetKey")):
        merged = sketches.rolled_up(parts.orderBy(order).coalesce(1), lg=9)
        assert sketches.changes(merged, (1, 2), by=(), lg=9).collect() == whole


@pytest.mark.parametrize("rows", [[], [(1, "a", 2001)]])
def test_empty_tables_and_one_snapshot(spark, rows):
    got = sketches.changes(sketches.id_sketches(frame(spark, rows)), (2001, 2002)).collect()
    assert [(r["kept"], r["new"], r["gone"]) for r in got] == ([(0, 0, 1)] if rows else [])
