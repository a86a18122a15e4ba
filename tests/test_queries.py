"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import os
import re

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from compare import differences, duck

import __spark_entry__ as entry_module
from snaplevel.registry import queries as registered
from snaplevel.registry import tables
from snaplevel.registry.oracles import ORACLES
from snaplevel.registry.queries import QUERIES
from snaplevel.streaming import changes

FOLDER = os.path.join(TESTDATA, "sf" + os.environ.get("TEST_SF", "0.001"))


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLES.items() <= entry_module.oracle_sql().items()


def scans(df, table):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum(1 for line in plan.splitlines() if "FileScan" in line and f"{table}.parquet" in line)


@pytest.mark.parametrize("name", ["join_totals", "union_groups", "element_trend_fraction"])
def test_records_are_scanned_once(spark, name):
    assert scans(QUERIES[name](spark, FOLDER), "orders") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


def test_files_for_a_stream_grow_with_the_records_but_not_its_batches(spark, con, monkeypatch, tmp_path):
    n = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    monkeypatch.setattr(tables, "SHARE_ORDERS", -(-n // 15))
    monkeypatch.setattr(registered, "work_folder", lambda _, name: str(tmp_path / name))
    assert differences(QUERIES["stream_changes"](spark, FOLDER), con, ORACLES["stream_changes"]) == []
    rows = spark.read.parquet(str(tmp_path / "incoming")).groupBy("_metadata.file_name").count().collect()
    assert len(rows) == 15 and max(r["count"] for r in rows) < 2 * min(r["count"] for r in rows)
    batches = changes.read_changes(spark, str(tmp_path / "changes")).select("batch").distinct()
    assert batches.count() == 3


def test_tasks_that_sort_by_snapshot_grow_in_number_with_the_records(spark, con, monkeypatch, tmp_path):
    n = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    monkeypatch.setattr(tables, "TASK_ORDERS", -(-n // 20))
    monkeypatch.setattr(registered, "work_folder", lambda _, name: str(tmp_path / name))
    assert differences(QUERIES["write_scored"](spark, FOLDER), con, ORACLES["write_scored"]) == []
    tasks = spark.read.parquet(str(tmp_path / "scored")).groupBy(F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1)).count()
    sizes = [r["count"] for r in tasks.collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * min(sizes)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:4] == ["interval", "transition", "direction", "n_records"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["score_records", "level_transitions", "new_record_elements"])
def test_plans_stay_in_the_jvm_and_prune_columns(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|CartesianProduct|BroadcastNestedLoopJoin", plan)
    scans = [line for line in plan.splitlines() if "FileScan" in line and "orders" in line]
    assert scans and all("o_totalprice" not in line for line in scans)
