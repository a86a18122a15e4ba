from __future__ import annotations

import random
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.operators import series as X
from snaplevel.operators.series import NEW, OLD, SnapshotSeries
from snaplevel.plans import analyses as A

SCHEMA = "gbifID long, datasetKey string, MIDS_level tinyint, snapshot_year int"
FLAGGED = SCHEMA + ", `mids:MIDS0A` boolean, `mids:MIDS1B` boolean"


def series(spark, rows, years=None, schema=SCHEMA):
    return SnapshotSeries.of(spark.createDataFrame(rows, schema), years)


def as_counter(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_years_are_found_and_ordered(spark):
    s = series(spark, [(1, "d", 0, 2019), (1, "d", 0, 2016), (2, "d", 0, 2018)])
    assert s.years == (2016, 2018, 2019)
    assert {(r.snapshot_year, r.snapshot_idx) for r in s.indexed().collect()} == {
        (2016, 0), (2018, 1), (2019, 2)
    }


def test_a_record_that_returns_is_new_again(spark):
    s = series(
        spark, [(1, "d", 0, 2000), (1, "d", 1, 2002), (2, "d", 0, 2001), (2, "d", 0, 2002)],
        [2000, 2001, 2002],
    )
    assert as_counter(A.new_record_levels(s), "year", S.LEVEL, "n") == {
        (2001, 0): 1, (2002, 1): 1
    }


def test_predecessor_is_the_available_snapshot(spark):
    s = series(spark, [(1, "d", 0, 2016), (1, "d", 1, 2018)])  # no 2017
    assert as_counter(A.new_record_levels(s), "year", S.LEVEL, "n") == {}
    assert [r.interval for r in A.level_transitions(s).collect()] == ["2016-2018"]


def test_repeated_ids_multiply_and_matched_plus_new_exceeds_the_total(spark):
    s = series(
        spark,
        [(1, "a", 0, 2020), (1, "a", 0, 2020), (1, "b", 1, 2020), (1, "a", 1, 2021),
         (2, "a", 0, 2021), (3, "a", 0, 2020)],
    )
    matched = X.matched_levels(s).agg(F.sum("n")).first()[0]
    new = A.new_record_levels(s).agg(F.sum("n")).first()[0]
    assert (matched, new, s.select(2021).count()) == (3, 1, 2)
    surplus = {r.snapshot_year: r.surplus_rows for r in X.repeated_ids(s).collect()}
    assert surplus == {2020: 2, 2021: 0}


def test_rows_without_id(spark):
    s = series(spark, [(None, "d", 0, 2020), (None, "d", 1, 2021), (1, "d", 1, 2021)])
    # SQL joins never match them, data-frame joins match them with each other.
    assert as_counter(A.new_record_levels(s), "year", S.LEVEL, "n") == {(2021, 1): 2}
    assert X.new_observations(s, empty_ids_match=True).agg(F.sum("n")).first()[0] == 1
    assert X.matched_levels(s).count() == 1
    current, previous = s.select(2021), s.select(2020)
    assert X.new_records(current, previous).count() == 2
    assert X.new_records(current, previous, empty_ids_match=True).count() == 1
    assert X.new_rows_of_series(s).count() == 2
    assert X.new_rows_of_series(s, empty_ids_match=True).count() == 1


def test_tie_between_transitions_goes_to_the_first(spark):
    s = series(
        spark,
        [(1, "d", 0, 2020), (2, "d", 1, 2020), (1, "d", 1, 2021), (2, "d", 0, 2021)],
    )
    assert [r.transition for r in A.largest_transition(s).collect()] == ["MIDS 0 → MIDS 1"]


def test_percentages_of_the_top_are_taken_before_the_cut(spark):
    rows = []
    for i in range(12):
        for k in range(i + 1):
            rows += [(i * 100 + k, f"d{i:02}", 1, 2020), (i * 100 + k, f"d{i:02}", 0, 2021)]
    top = A.top_level_drop(series(spark, rows), 2020, 2021, k=3).collect()
    assert [(r.datasetKey, r.records_1_to_0) for r in top] == [("d11", 12), ("d10", 11), ("d09", 10)]
    assert top[0].pct_of_all_1_to_0 == pytest.approx(100 * 12 / 78)


def random_rows(seed, n_ids=40, years=(2016, 2018, 2019, 2020)):
    """Rows with repeated and missing ids, and one id that holds a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for year in years:
        for i in range(n_ids):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                rows.append((i if i else None, rng.choice(["a", "b", None]), rng.randint(-1, 3), year))
        for _ in range(len(rows) // (2 * len(years)) + 5):
            rows.append((7, rng.choice("abc"), rng.randint(-1, 3), year))
    return [(*r, rng.random() < 0.5, rng.random() < 0.5) for r in rows], years


def by_year(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[3]].append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_transitions_and_declines_equal_nested_loops(spark, seed):
    rows, years = random_rows(seed)
    snapshots, s = by_year(rows), series(spark, rows, years, FLAGGED)
    pairs, declines = Counter(), Counter()
    for i, (a, b) in enumerate(zip(years, years[1:])):
        for old in snapshots[a]:
            for new in snapshots[b]:
                if old[0] == new[0]:
                    pairs[i, old[2], new[2]] += 1
                    if new[2] < old[2]:
                        declines[old[1]] += 1
    got = X.matched_levels(s).groupBy(S.SNAPSHOT_IDX, OLD, NEW).agg(F.sum("n").alias("n"))
    assert as_counter(got, S.SNAPSHOT_IDX, OLD, NEW, "n") == dict(pairs)
    ranked = A.declining_datasets(s)
    assert {r.datasetKey: r.n_declined_specimens for r in ranked.collect()} == dict(declines)
    total = A.level_transitions(s).where("direction = 'Decrease'").agg(F.sum("n_records"))
    assert total.first()[0] == sum(declines.values())


@pytest.mark.parametrize("seed", range(3))
def test_new_records_equal_nested_loops(spark, seed):
    rows, years = random_rows(seed)
    snapshots, s = by_year(rows), series(spark, rows, years, FLAGGED)
    levels, elements = Counter(), Counter()
    for a, b in zip(years, years[1:]):
        known = {r[0] for r in snapshots[a]}
        for r in snapshots[b]:
            if r[0] not in known or r[0] is None:
                levels[b, r[2]] += 1
            if r[0] not in known:
                elements[b, "MIDS0A"] += r[4]
                elements[b, "MIDS1B"] += r[5]
    assert as_counter(A.new_record_levels(s), "year", S.LEVEL, "n") == dict(levels)
    got = as_counter(A.new_record_elements(s), "year", "element", "true_count")
    assert got == {k: v for k, v in elements.items() if (k[0], "MIDS0A") in got}


@pytest.mark.parametrize("seed", range(3))
def test_cohorts_equal_nested_loops(spark, seed):
    rows, years = random_rows(seed)
    snapshots, s = by_year(rows), series(spark, rows, years, FLAGGED)
    base, cohorts = Counter(), Counter()
    for y in years:
        for b in snapshots[years[0]]:
            for r in snapshots[y]:
                if b[0] == r[0]:
                    base[y, r[2]] += 1
    for i, (a, c) in enumerate(zip(years, years[1:]), start=1):
        known = {r[0] for r in snapshots[a]}
        for start in (r for r in snapshots[c] if r[0] not in known):
            for y in years[i:]:
                for r in snapshots[y]:
                    if r[0] == start[0]:
                        cohorts[c, y, r[2]] += 1
    assert as_counter(A.base_cohort_levels(s), S.SNAPSHOT_YEAR, S.LEVEL, "n") == dict(base)
    followed = A.intake_cohort_levels(s)
    assert as_counter(followed, "cohort_year", S.SNAPSHOT_YEAR, S.LEVEL, "n") == dict(cohorts)
    entry = A.cohort_entry_levels(A.intake_cohort_levels(s, years[-2]))
    assert {r.cohort_year for r in entry.collect()} <= set(years[1:-1])


def test_one_heavy_id_in_two_large_snapshots_is_counted_not_paired(spark):
    """300,000 x 300,000 row pairs of one id: counting them takes a handful of rows."""
    rows = spark.range(0, 900_000, 1, 8).select(
        F.when(F.col("id") % 3 < 2, F.lit(7)).otherwise(F.col("id")).alias("gbifID"),
        F.lit("d").alias("datasetKey"),
        (F.col("id") % 5 - 1).cast("tinyint").alias("MIDS_level"),
        F.when(F.col("id") % 3 == 0, 2020).otherwise(2021).alias("snapshot_year"),
    )
    s = SnapshotSeries.of(rows, [2020, 2021])
    assert X.matched_levels(s).count() == 25
    assert X.matched_levels(s).agg(F.sum("n")).first()[0] == 300_000 * 300_000


def test_stated_uniqueness_saves_a_shuffle_and_changes_no_result(spark):
    rows, years = random_rows(1)  # with repeated ids all the same
    plain = series(spark, rows, years, FLAGGED)
    stated = replace(plain, ids_unique=True)
    analyses = (
        A.new_record_levels, A.new_record_elements, A.level_transitions, A.base_cohort_levels,
        A.intake_cohort_levels, A.decline_severity, X.repeated_ids,
        lambda s: A.top_level_drop(s, years[0], years[-1]),
    )
    for analysis in analyses:
        assert sorted(map(str, analysis(stated).collect())) == sorted(
            map(str, analysis(plain).collect())
        )
    records = (
        X.matched_levels, X.base_cohort, X.intake_cohorts, X.observations,
        lambda s: X.matched_levels(s, "datasetKey"), lambda s: X.observations(s, S.LEVEL, "datasetKey"),
        lambda s: X.new_observations(s, S.LEVEL, empty_ids_match=True),
    )
    repeated = [(1, "d", 1, 2020), (1, "d", 1, 2020), (1, "e", 2, 2020), (None, "d", 0, 2020), (None, "d", 0, 2020),
                (1, "d", 3, 2021), (1, "d", 3, 2021), (None, "d", -1, 2021)]
    few = series(spark, repeated)
    for record in records:
        for one in (plain, few):
            assert sorted(map(str, record(replace(one, ids_unique=True)).collect())) == sorted(map(str, record(one).collect()))
    plan = X.matched_levels(stated)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_series_analyses_need_two_shuffles_and_no_join(spark):
    rows, years = random_rows(0)
    s = series(spark, rows, years, FLAGGED)
    plan = X.matched_levels(s)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 2
    assert "Join" not in initial


def test_a_level_beyond_the_scale_is_not_lost(spark):
    s = series(spark, [(1, "d", 3, 2020), (1, "d", 4, 2021), (2, "d", 1, 2020), (2, "d", 1, 2021)])
    with pytest.raises(Exception, match="no completeness level: 4"):
        X.matched_levels(s).collect()
