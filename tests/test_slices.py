from __future__ import annotations

import math

from snaplevel.operators import slices, summary

SCHEMA = (
    "gbifID long, datasetKey string, MIDS_level tinyint, `mids:MIDS0A` boolean, "
    "`mids:MIDS1B` boolean, year smallint, countryCode string, phylum string, snapshot_year int"
)
ROWS = [
    (1, "d", 0, True, False, 1700, "BE", "Chordata", 2020),
    (2, "d", 1, True, True, 1950, "TR", "Chordata", 2020),
    (3, None, 1, True, True, None, None, "Bryophyta", 2020),
    (4, None, -1, False, True, 2030, "XX", None, 2020),
    (5, "e", 1, True, True, 2001, "TR", "Odd", 2021),
]
KINGDOMS = [("Chordata", "Animalia"), ("Bryophyta", "Plantae"), ("Odd", "Bacteria")]
CONTINENTS = [("BE", "Europe"), ("TR", "Europe"), ("TR", "Asia")]


def data(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def kingdoms(spark):
    return spark.createDataFrame(KINGDOMS, "phylum string, kingdom string")


def test_country_with_two_continents_counts_in_both(spark):
    lookup = spark.createDataFrame(CONTINENTS, "countryCode string, continent string")
    got = slices.continent_completeness(data(spark), lookup).where("column_name = '0A'").collect()
    assert {(r.continent, r.snapshot_year): r.total_rows for r in got} == {
        ("Europe", 2020): 2, ("Asia", 2020): 1, ("Europe", 2021): 1, ("Asia", 2021): 1
    }


def test_unique_continents(spark):
    from snaplevel.sources.lookups import unique_continents

    lookup = spark.createDataFrame(CONTINENTS, "countryCode string, continent string")
    assert {tuple(r) for r in unique_continents(lookup).collect()} == {
        ("BE", "Europe"), ("TR", "Asia")
    }


def test_kingdom_without_records_keeps_its_rows(spark):
    got = slices.kingdom_completeness(data(spark), kingdoms(spark)).collect()
    rows = {(r.kingdom, r.snapshot_year, r.column_name): r for r in got}
    assert len(rows) == 3 * 2 * 2
    assert rows["Animalia", 2020, "1B"].true_percentage == 50.0
    empty = rows["Fungi", 2020, "0A"]
    assert (empty.total_rows, empty.true_count) == (0, 0) and math.isnan(empty.true_percentage)


def test_kingdoms_looked_up_in_one_snapshot(spark):
    got = slices.kingdom_completeness(data(spark), kingdoms(spark), lookup_year=2021).collect()
    assert {r.kingdom: r.total_rows for r in got if r.total_rows} == {}


def test_empty_period_has_no_rows(spark):
    got = slices.period_completeness(data(spark)).where("column_name = '0A'").collect()
    assert {(r.year_group, r.snapshot_year): r.total_rows for r in got} == {
        ("Pre-1800", 2020): 1, ("1950-1999", 2020): 1, ("Unknown", 2020): 2, ("2000-2024", 2021): 1
    }


def test_rows_without_data_set_form_one_data_set(spark):
    got = slices.levels_by_dataset_size(data(spark), (2, 3, 4)).collect()
    assert {(r.size_class, r.MIDS_level, r.snapshot_year): r.n_records for r in got} == {
        ("Medium", -1, 2020): 1, ("Medium", 0, 2020): 1, ("Medium", 1, 2020): 2,
        ("Small", 1, 2021): 1,
    }
    joined = slices.join_size_class(data(spark), (2, 3, 4)).collect()
    assert {r.gbifID: (r.n_records, r.size_class) for r in joined} == {
        1: (2, "Medium"), 2: (2, "Medium"), 3: (2, "Medium"), 4: (2, "Medium"), 5: (1, "Small")
    }


def test_phylum_counts_keep_null(spark):
    got = {r.phylum: (r.n, r.kingdom) for r in slices.phylum_counts(data(spark), kingdoms(spark)).collect()}
    assert got == {
        "Chordata": (2, "Animalia"), "Bryophyta": (1, "Plantae"), "Odd": (1, "Bacteria"),
        None: (1, None),
    }


def test_summary_table_stacks_elements_and_levels(spark):
    got = {
        r.column_name: (r.total_rows, r.true_count, r.false_count, r.true_percentage)
        for r in summary.stack_elements_levels(data(spark)).collect()
    }
    assert got == {
        "0A": (5, 4, 1, 80.0), "1B": (5, 4, 1, 80.0),
        "-1": (5, 1, None, 20.0), "0": (5, 1, None, 20.0), "1": (5, 3, None, 60.0),
    }


def test_summary_scans_once(spark, tmp_path):
    path = str(tmp_path / "scored")
    data(spark).write.parquet(path)
    plan = summary.stack_elements_levels(spark.read.parquet(path))
    initial = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert initial.count("FileScan") == 1


def test_true_false_long(spark):
    long = summary.true_false_long(summary.element_table(data(spark)))
    assert {(r.column_name, r.achieved): r.true_count for r in long.collect()} == {
        ("0A", "1"): 4, ("0A", "0"): 1, ("1B", "1"): 4, ("1B", "0"): 1
    }


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "scored")
    data(spark).write.partitionBy("snapshot_year").parquet(path)
    df = slices.continent_completeness(
        spark.read.parquet(path).where("snapshot_year = 2020"),
        spark.createDataFrame(CONTINENTS, "countryCode string, continent string"),
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "IsNotNull(countryCode)" in scan and "snapshot_year" in scan.split("PartitionFilters")[1]
    assert "phylum" not in scan.split("ReadSchema")[1]
