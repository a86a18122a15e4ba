"""The history table says of every series what the series itself says."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.operators import history as H
from snaplevel.operators.series import SnapshotSeries
from snaplevel.plans import analyses as A

YEARS = (2001, 2002, 2004, 2005, 2009)
FLAGS = ["mids:MIDS0A", "mids:MIDS1B"]
ANALYSES = {
    "level_transitions": A.level_transitions,
    "change_status": A.change_status_by_interval,
    "declining_datasets_by_interval": A.declining_datasets_by_interval,
    "decline_severity": A.decline_severity,
    "level_drop": lambda s: A.top_level_drop(s, 2002, 2005, 2, 0, k=100),
    "base_cohort": A.base_cohort_levels,
    "intake_cohorts": A.intake_cohort_levels,
    "new_levels": A.new_record_levels,
    "new_elements": A.new_record_elements,
}


def random_rows(seed, n_ids=40, repeats=3):
    """Records that come, change, vanish and return; some ids repeat, many rows have none."""
    rng = random.Random(seed)
    rows = []
    for i in range(n_ids):
        key = None if i % 9 == 0 else i // (1 + (i % 7 == 0))
        state = (f"d{rng.randrange(3)}", rng.randrange(-1, 4), rng.random() < 0.5, rng.random() < 0.5)
        for year in YEARS:
            if rng.random() < 0.3:
                state = (rng.choice(["d0", "d1", None]), rng.choice([-1, 0, 1, 2, 3]), rng.random() < 0.5, True)
            if rng.random() < 0.8:
                rows += [(key, *state, year)] * (rng.randrange(1, repeats) if i % 5 == 0 else 1)
    return rows


def series_of(spark, rows):
    schema = f"gbifID long, datasetKey string, MIDS_level tinyint, `{FLAGS[0]}` boolean, `{FLAGS[1]}` boolean, snapshot_year int"
    return SnapshotSeries.of(spark.createDataFrame(rows, schema).repartition(4), YEARS)


def same(a, b):
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))  # noqa: E731  NaN equals itself as text
    assert rows(a) == rows(b)


@pytest.fixture(scope="module", params=[1])
def both(request, spark, tmp_path_factory):
    series = series_of(spark, random_rows(request.param))
    series = SnapshotSeries(series.rows.cache(), series.years)
    return series, H.build(series, str(tmp_path_factory.mktemp("history") / "runs"))


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_analyses_equal_those_of_the_series(both, name):
    series, history = both
    same(ANALYSES[name](series), ANALYSES[name](history))


@pytest.mark.parametrize("name", ["level_transitions", "decline_severity"])
def test_long_lists_of_runs_are_counted_out(both, monkeypatch, name):
    monkeypatch.setattr(H, "MOST_RUNS", 1)
    series, history = both
    same(ANALYSES[name](series), ANALYSES[name](history))


@pytest.mark.parametrize("years", [(2001, 2009), (2002, 2004, 2005), (2005,)])
def test_some_of_the_snapshots(both, years):
    series, history = both
    for analysis in (A.level_transitions, A.new_record_levels, A.intake_cohort_levels):
        same(analysis(series.only(*years)), analysis(history.only(*years)))


def test_every_snapshot_can_be_read_back(both):
    series, history = both
    for year in YEARS:
        same(history.at(year), H.snapshot_states(series.select(year)))
    counts = series.rows.groupBy(S.SNAPSHOT_YEAR, S.LEVEL).count().withColumnRenamed("count", "n")
    levels = history.level_totals().withColumn(S.SNAPSHOT_YEAR, history.year_at(F.col(S.SNAPSHOT_IDX)))
    same(counts, levels.drop(S.SNAPSHOT_IDX))


def test_runs_are_as_long_as_they_can_be(both):
    _, history = both
    follows = history.rows.alias("a").join(
        history.rows.alias("b"),
        (F.expr("a.last_idx + 1 = b.first_idx")) & F.expr(" AND ".join(f"a.{c} <=> b.{c}" for c in H.STATE)),
    )
    assert follows.isEmpty()
    assert history.rows.count() < history.rows.agg(F.sum(F.expr("last_idx - first_idx + 1"))).first()[0]


def test_unchanged_records_are_one_row(spark, tmp_path):
    rows = [(i, "d", 1, True, False, y) for i in range(50) for y in YEARS]
    history = H.build(series_of(spark, rows), str(tmp_path / "runs"))
    assert history.rows.count() == 50
    assert history.flags == FLAGS


def test_a_new_snapshot_reads_only_itself_and_the_runs_before(spark, tmp_path):
    series, path, years = series_of(spark, random_rows(3)), str(tmp_path / "runs"), ()
    for year in YEARS[:-1]:
        years = H.add_snapshot(spark, path, series.select(year), year, years)
    before = sorted((tmp_path / "runs").rglob("*.parquet"))
    source = str(tmp_path / "last")
    series.select(YEARS[-1]).write.parquet(source)
    plan = H.merged(H._reaching(spark, path, years[-1]), H.snapshot_states(spark.read.parquet(source)), len(years))
    read = plan.inputFiles()
    assert read and all(f"snapshot_year={years[-1]}/open=" in f or "/last/" in f for f in read)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and "(open#" in text and " = 1)]" in text.replace("PartitionFilters", "\n")
    H.add_snapshot(spark, path, spark.read.parquet(source), YEARS[-1], years)
    assert set(before) <= set((tmp_path / "runs").rglob("*.parquet"))


def test_an_older_state_and_a_second_attempt(spark, tmp_path):
    rows = random_rows(4)
    path = str(tmp_path / "runs")
    H.build(series_of(spark, rows), path)
    older = H.read_history(spark, path, up_to=2004)
    assert older.years == (2001, 2002, 2004)
    same(A.level_transitions(series_of(spark, rows).only(*older.years)), A.level_transitions(older))
    H.add_snapshot(spark, path, series_of(spark, rows).select(2009), 2009, YEARS[:-1])
    again = H.read_history(spark, path)
    assert again.years == YEARS
    same(A.level_transitions(series_of(spark, rows)), A.level_transitions(again))


def test_refused_snapshots(spark, tmp_path):
    series, path = series_of(spark, random_rows(5)), str(tmp_path / "runs")
    years = H.add_snapshot(spark, path, series.select(2002), 2002)
    with pytest.raises(ValueError, match="not after"):
        H.add_snapshot(spark, path, series.select(2001), 2001, years)
    with pytest.raises(ValueError, match="no rows"):
        H.add_snapshot(spark, path, series.select(1950), 2003, years)
    with pytest.raises(ValueError, match="flags"):
        H.add_snapshot(spark, path, series.select(2004).drop(FLAGS[0]), 2004, years)


def test_a_heavy_id_is_a_few_rows(spark, tmp_path):
    rows = [(None, f"d{k % 2}", k % 3, True, True, y) for k in range(600) for y in YEARS] + random_rows(6)
    series = series_of(spark, rows)
    history = H.build(series, str(tmp_path / f"runs-{uuid.uuid4().hex}"))
    assert history.rows.where("gbifID IS NULL").count() < 100
    same(A.level_transitions(series), A.level_transitions(history))
    same(A.intake_cohort_levels(series), A.intake_cohort_levels(history))


def test_a_series_is_computed_once(spark, tmp_path):
    series = series_of(spark, random_rows(5))
    seen = spark.sparkContext.accumulator(0)
    schema, names = series.rows.schema, series.rows.columns

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counting = SnapshotSeries(series.rows.select(*names).mapInArrow(counted, schema), YEARS)
    history = H.build(counting, str(tmp_path / "runs"))
    assert seen.value == series.rows.count()
    assert H.history_years(spark, str(tmp_path / "runs")) == YEARS
    same(A.level_transitions(series), A.level_transitions(history))
