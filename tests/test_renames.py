"""Changed ids equal repeated mutual best matches, one at a time; ranks equal plain ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from snaplevel.operators import renames
from snaplevel.operators.ranks import ranked

RULES = (renames.MatchRule("one", ("a", "b"), ("c",)), renames.MatchRule("two", ("d",)), renames.MatchRule("three", ("e",), ("a", "f")))
COLUMNS = ["a", "b", "c", "d", "e", "f"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "gbifID long, " + ", ".join(f"{c} string" for c in COLUMNS)).repartition(3)


def brute(previous, current, rules=RULES):
    def kept(rows):
        out = {}
        for i, *values in rows:
            if i is not None:
                row = tuple(None if v in ("", "unknown:undigitized") else v for v in values)
                key = tuple((v is not None, v or "") for v in row)
                if i not in out or key < out[i][0]:
                    out[i] = key, dict(zip(COLUMNS, row, strict=True))
        return {i: row for i, (_, row) in out.items()}

    a, b = kept(previous), kept(current)
    old = {i: r for i, r in a.items() if i not in b}
    new = {i: r for i, r in b.items() if i not in a}
    found = set()
    for rule in rules:
        for agree in [rule.agree, ()] if rule.agree else [()]:
            while True:  # the smallest ids that are each other's best
                pairs = [
                    (i, j) for i in sorted(old) for j in sorted(new)
                    if all(old[i][c] is not None and old[i][c] == new[j][c] for c in rule.keys)
                    and all(old[i][c] == new[j][c] for c in agree)
                ]
                if not pairs:
                    break
                i, j = pairs[0]
                found.add((i, j, rule.name, agree == rule.agree))
                del old[i], new[j]
    return found


def random_rows(rng, ids):
    pick = lambda *x: rng.choice(x)
    return [(i, pick("x", "y", None, ""), pick("1", "2", "3"), pick("k", None), pick("p", "", "unknown:undigitized", None), pick("q", None), pick("z", None)) for i in ids]


def test_equals_one_match_at_a_time(spark):
    rng = random.Random(3)
    previous = random_rows(rng, [*range(60), *range(10), None, None])
    current = random_rows(rng, [*range(40, 110), *range(45, 50), None])
    got = {tuple(r) for r in renames.changed_ids(frame(spark, previous), frame(spark, current), RULES).collect()}
    assert got == brute(previous, current)
    assert len({r[2:] for r in got}) == 5


def test_a_hot_block_is_matched_in_ranges(spark):
    previous = [(i, "x", "1", None, None, None, None) for i in range(3000)]
    current = [(10_000 + i, "x", "1", None, None, None, None) for i in range(2000)] + [(99_999, "y", "1", None, None, None, None)]
    got = renames.changed_ids(frame(spark, previous), frame(spark, current), RULES[:1])
    assert sorted((r[0], r[1]) for r in got.collect()) == [(i, 10_000 + i) for i in range(2000)]


def test_nothing_changed_and_empty_tables(spark):
    rows = [(1, "x", "1", "c", "d", "e", "f")]
    assert renames.changed_ids(frame(spark, rows), frame(spark, rows), RULES).collect() == []
    assert renames.changed_ids(frame(spark, []), frame(spark, rows), RULES).collect() == []


def test_missing_texts_per_column(spark):
    previous, current = [(1, "-", "1", None, None, None, None)], [(2, "-", "1", None, None, None, None)]
    rules = RULES[:1]
    assert len(renames.changed_ids(frame(spark, previous), frame(spark, current), rules).collect()) == 1
    assert renames.changed_ids(frame(spark, previous), frame(spark, current), rules, {"a": ("-",)}).collect() == []


def test_ranks_of_groups_over_several_slices(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(5)
    got = ranked(df, ["g"], ["k"]).collect()
    want = {}
    for g, k in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, []).append(k)
    assert {(r["g"], r["k"], r["rank"]) for r in got} == {(g, k, n) for g, ks in want.items() for n, k in enumerate(ks, 1)}
    assert ranked(df.where(F.lit(False)), ["g"], ["k"]).collect() == []
