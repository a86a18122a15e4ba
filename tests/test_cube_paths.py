"""The cube answers four analyses from one scan; paths add up to the transitions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_history import YEARS, random_rows, same, series_of

from snaplevel import schema as S
from snaplevel.operators import cube, history, paths, slices
from snaplevel.operators.series import N
from snaplevel.registry import tables


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [
        (k, rng.choice(["d0", "d1", None]), rng.randrange(-1, 4), rng.random() < 0.5, rng.random() < 0.2,
         rng.choice([1700, 1850, 1910, 1980, 2010, 2100, None]), rng.choice(["A", "B", "C", None]),
         rng.choice(["p0", "p1", "p2", None]), rng.choice([2001, 2002]))
        for k in range(800)
    ]
    schema = ("gbifID long, datasetKey string, MIDS_level tinyint, `mids:MIDS0A` boolean, `mids:MIDS1B` boolean, year smallint,"
              " countryCode string, phylum string, snapshot_year int")
    path = str(tmp_path_factory.mktemp("scored") / "rows")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_four_analyses_equal_those_of_the_rows(spark, scored, tmp_path):
    cube.write_cube(cube.cube_of(scored), str(tmp_path / "cube"))
    found = cube.read_cube(spark, str(tmp_path / "cube"))
    kingdoms = spark.createDataFrame([("p0", "Animalia"), ("p1", "Plantae"), ("p9", "Fungi")], "phylum string, kingdom string")
    continents = spark.createDataFrame([("A", "Asia"), ("B", "Asia"), ("B", "Europe")], "countryCode string, continent string")
    same(found.kingdom_completeness(kingdoms), slices.kingdom_completeness(scored, kingdoms))
    same(found.kingdom_completeness(kingdoms, lookup_year=2002), slices.kingdom_completeness(scored, kingdoms, lookup_year=2002))
    same(found.continent_completeness(continents), slices.continent_completeness(scored, continents))
    same(found.period_completeness(), slices.period_completeness(scored))
    same(found.levels_by_dataset_size((100, 140, 200)), slices.levels_by_dataset_size(scored, (100, 140, 200)))
    assert found.flags == S.flag_columns(scored)
    for dimension in cube.DIMENSIONS:
        assert found.along(dimension).agg(F.sum("n")).first()[0] == 800
    totals = found.roll_up(found.along(S.PHYLUM), [S.SNAPSHOT_YEAR])
    same(totals.select(S.SNAPSHOT_YEAR, F.col("total_rows").alias("n")), scored.groupBy(S.SNAPSHOT_YEAR).agg(F.count("*").alias("n")))
    with pytest.raises(ValueError, match="not a dimension"):
        found.along("gbifID")


def test_one_scan_makes_the_cube_and_the_analyses_read_only_it(spark, scored, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(cube.cube_of(scored).rows).count("FileScan") == 1
    cube.write_cube(cube.cube_of(scored), str(tmp_path / "cube"))
    found = cube.read_cube(spark, str(tmp_path / "cube"))
    text = plan(found.period_completeness())
    assert text.count("FileScan") == 1 and "dimension" in text.split("PartitionFilters")[1][:200]


def test_paths_of_random_series(spark, tmp_path):
    rows = random_rows(11) + [(None, "d", 1, True, True, 2001)] * 3
    table = history.build(series_of(spark, rows), str(tmp_path / "runs"))
    found = paths.level_paths(table)
    states = Counter()
    for key, _, level, *_, year in rows:
        states[key, year, level] += 1
    want = Counter()
    for key in {k for k, _, _ in states}:
        parts = []
        for year in YEARS:
            here = sorted((lv, n) for (k, y, lv), n in states.items() if (k, y) == (key, year))
            parts.append("+".join(str(lv) if n == 1 else f"{lv}x{n}" for lv, n in here) or "-")
        want[">".join(parts)] += 1
    got = found.select(paths.path_text(F.col("path")).alias("p"), "n_records").collect()
    assert {r["p"]: r["n_records"] for r in got} == want
    same(paths.path_transitions(found), table.transition_totals().select(S.SNAPSHOT_IDX, "MIDS_level_old", "MIDS_level_new", N))

    tree = paths.path_tree(found).collect()
    nodes = Counter()
    for p, n in want.items():
        parts = p.split(">")
        for depth in range(1, len(parts) + 1):
            nodes[depth, ">".join(parts[:depth])] += n
    assert {(r["depth"], r["node"]): r["n_records"] for r in tree} == nodes
    for r in tree:
        assert r["parent"] == ">".join(r["node"].split(">")[:-1])
        assert abs(r["share"] - r["n_records"] / (nodes[r["depth"] - 1, r["parent"]] or sum(want.values()))) < 1e-12


def test_paths_of_one_snapshot_and_eight_mapping_sets(spark, tmp_path):
    table = history.build(series_of(spark, [(1, "d", 0, True, True, 2001), (2, "d", 0, True, True, 2001)]).only(2001), str(tmp_path / "runs"))
    found = paths.level_paths(table)
    assert [(r["p"], r["n_records"]) for r in found.select(paths.path_text(F.col("path")).alias("p"), "n_records").collect()] == [("0", 2)]
    assert paths.path_transitions(found).collect() == []
    assert len(tables.mapping_sets()) == 8
