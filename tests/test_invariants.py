"""Relations that must hold between results, on the derived series."""

from __future__ import annotations

import os

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.operators import slices, summary
from snaplevel.operators import series as X
from snaplevel.operators.series import SnapshotSeries
from snaplevel.operators.scoring import score_records
from snaplevel.plans import analyses as A
from snaplevel.registry import tables

FOLDER = os.path.join(TESTDATA, "sf0.01")


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    """The scored series with unique ids, written once and read back as the analyses do."""
    path = str(tmp_path_factory.mktemp("scored") / "t")
    raw = tables.raw_series(spark, FOLDER, record_id=tables.ORDER_ID)
    score_records(raw, extra=[S.SNAPSHOT_YEAR]).write.partitionBy(S.SNAPSHOT_YEAR).parquet(path)
    return SnapshotSeries.of(spark.read.parquet(path))


def sums(df, key, value):
    return {r[key]: r["s"] for r in df.groupBy(key).agg(F.sum(value).alias("s")).collect()}


def test_level_counts_add_up_to_the_rows(series):
    totals = {r[S.SNAPSHOT_YEAR]: r["n"] for r in A.row_counts(series).collect()}
    assert series.years == tables.YEARS and set(totals) == set(tables.YEARS)
    assert sums(summary.level_distribution(series.rows, [S.SNAPSHOT_YEAR]), S.SNAPSHOT_YEAR, "n") == totals


def test_trend_equals_summary(series):
    year = tables.LAST_YEAR
    table = {
        "MIDS" + r.column_name: r.true_count
        for r in A.snapshot_summary(series, year).where("false_count is not null").collect()
    }
    trend = A.element_trend_counts(series).where(F.col(S.SNAPSHOT_YEAR) == year).collect()
    assert {r.element: r.true_count for r in trend} == table and len(table) == 18


def test_matched_plus_new_is_the_total(series):
    totals = {r[S.SNAPSHOT_YEAR]: r["n"] for r in A.row_counts(series).collect()}
    matched = sums(A.transition_counts(series), S.SNAPSHOT_IDX, "n_records")
    new = sums(A.new_record_levels(series), "year", "n")
    elements = {r.year: r.total_new for r in A.new_record_elements(series).collect()}
    assert new == elements
    for i, year in enumerate(series.years[1:]):
        assert matched[i] + new[year] == totals[year]


def test_repeated_ids_make_matched_plus_new_exceed_the_total(spark):
    series = tables.scored_series(spark, FOLDER)
    totals = {r[S.SNAPSHOT_YEAR]: r["n"] for r in A.row_counts(series).collect()}
    matched = sums(A.transition_counts(series), S.SNAPSHOT_IDX, "n_records")
    new = {r.year: r.total_new for r in A.new_record_elements(series).collect()}
    surplus = {r[S.SNAPSHOT_YEAR]: r["surplus_rows"] for r in X.repeated_ids(series).collect()}
    assert all(s > 0 for s in surplus.values())
    for i, year in enumerate(series.years[1:]):
        assert matched[i] + new[year] > totals[year]


def test_decreases_equal_declines(series):
    down = A.direction_summary(series).where("direction = 'Decrease'").agg(F.sum("n_records"))
    severity = A.decline_severity(series).agg(F.sum("specimens_declined"))
    by_interval = A.declining_datasets_by_interval(series).agg(F.sum("n_declined_specimens"))
    assert down.first()[0] == severity.first()[0] == by_interval.first()[0] > 0


def test_top_percentage_is_of_the_transition_total(series):
    total = A.level_transitions(series).where(
        "interval = '1998-1999' and transition = 'MIDS 1 → MIDS 0'"
    ).first()["n_records"]
    top = A.top_level_drop(series, 1998, 1999).first()
    assert top["pct_of_all_1_to_0"] == 100 * top["records_1_to_0"] / total


def test_phylum_counts_add_up_also_per_kingdom(spark, series):
    last = series.select(tables.LAST_YEAR)
    kingdoms = tables.kingdoms(spark)
    counts = slices.phylum_counts(last, kingdoms)
    assert counts.agg(F.sum("n")).first()[0] == last.count()
    animals = counts.where("kingdom = 'Animalia'").agg(F.sum("n")).first()[0]
    one = slices.summary_for_kingdom(last, kingdoms).select("total_rows").distinct().collect()
    assert [r[0] for r in one] == [animals]


def test_cohort_entry_equals_new_records(series):
    entry = sums(A.cohort_entry_levels(A.intake_cohort_levels(series)), "cohort_year", "n")
    assert entry == sums(A.new_record_levels(series), "year", "n")


def test_measured_counts_of_the_fixture_recipe(spark):
    """Record counts under the other withholding rule that the fixtures were measured with."""
    raw = tables.raw_series(
        spark,
        FOLDER,
        (1999, 2000, 2002),
        withheld="(o_orderkey * 31 + {Y}) % 53 = 0",
        record_id=tables.ORDER_ID,
    )
    scored = score_records(raw, extra=[S.SNAPSHOT_YEAR])
    pair = SnapshotSeries.of(scored, (1999, 2000))
    assert pair.select(2000).count() == 11_122
    assert X.matched_levels(pair).agg(F.sum("n")).first()[0] == 8_690
    assert A.new_record_levels(pair).agg(F.sum("n")).first()[0] == 2_432
    phyla = summary.count_by_key(scored.where(F.col(S.SNAPSHOT_YEAR) == 2002), S.PHYLUM)
    assert sorted(r["n"] for r in phyla.collect()) == [509, 2815, 2831, 2839, 2859, 2864]
