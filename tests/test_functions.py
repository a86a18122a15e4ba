from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from snaplevel.functions import bins, labels
from snaplevel.functions.shares import fraction, percent


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_wrap_label(spark):
    texts = ["short", "exactly10c", "PhysicalSpecimenID", "twentycharacterslong"]
    assert column(spark, texts, "string", labels.wrap_label) == [
        "short", "exactly10c-", "PhysicalSp-\necimenID", "twentychar-\nacterslong-"
    ]


@pytest.mark.parametrize(
    "value, label",
    [(75.0, "75%"), (0.0, "0%"), (0.04, "0%"), (73.2005, "73.2%"), (0.25, "0.2%"), (0.35, "0.3%"),
     (0.15, "0.1%"), (99.96, "100%"), (100.0, "100%")],
)
def test_percent_label(spark, value, label):
    assert column(spark, [value], "double", labels.percent_label) == [label]


def test_snapshot_year_of_a_file_name(spark):
    paths = [
        "outputs/set_2016-06-07_0004071-160526112335914.parquet",
        "/data/2001-01-01/set_2026-01-01_00702026-09-12 07.05PM.parquet",
        "outputs/undated.parquet",
        "x/dump=2019-01-02/",
    ]
    assert column(spark, paths, "string", labels.parse_snapshot_year) == [2016, 2026, None, 2019]


def test_element_labels(spark):
    names = ["MIDS0Organization", "MIDS3MediaID", "Other"]
    assert column(spark, names, "string", labels.element_group) == ["MIDS 0", "MIDS 3", None]
    assert column(spark, ["mids:MIDS1Name"], "string", labels.strip_element_prefix) == ["MIDS1Name"]
    assert column(spark, ["mids:MIDS1Name"], "string", labels.strip_level_prefix) == ["1Name"]
    assert column(spark, ["1Name"], "string", labels.label_level) == ["1"]
    assert column(spark, ["1Name"], "string", labels.label_element) == ["Name"]


def test_separate_key(spark):
    for part, expected in ((0, [2016, 2016]), (1, ["<0", "2"])):
        keys = ["2016:-1", "2016:2"]
        assert column(spark, keys, "string", lambda c: labels.separate_key(c)[part]) == expected


def test_transition_labels(spark):
    df = spark.createDataFrame([(-1, 2), (3, 0), (1, 1)], "a tinyint, b tinyint")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        labels.transition_label(a, b), labels.change_status(a, b), labels.change_direction(a, b),
        labels.level_change(a, b),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("MIDS -1 → MIDS 2", "Changed", "Increase", 3),
        ("MIDS 3 → MIDS 0", "Changed", "Decrease", -3),
        ("MIDS 1 → MIDS 1", "Unchanged", "Decrease", 0),
    ]


def test_size_class_bounds(spark):
    sizes = [1, 9_999, 10_000, 99_999, 100_000, 999_999, 1_000_000]
    assert column(spark, sizes, "long", bins.size_class) == [
        "Small", "Small", "Medium", "Medium", "Large", "Large", "Very Large"
    ]


def test_collection_periods(spark):
    years = [None, 1700, 1799, 1800, 1899, 1900, 1949, 1950, 1999, 2000, 2024, 2025]
    assert column(spark, years, "smallint", bins.year_group) == [
        "Unknown", "Pre-1800", "Pre-1800", "1800-1899", "1800-1899", "1900-1949", "1900-1949",
        "1950-1999", "1950-1999", "2000-2024", "2000-2024", "Unknown",
    ]


def test_shares_of_an_empty_whole_are_nan(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a long, b long")
    got = df.orderBy("b").select(
        fraction(F.col("a"), F.col("b")), percent(F.col("a"), F.col("b"))
    ).collect()
    assert math.isnan(got[0][0]) and math.isnan(got[0][1])
    assert tuple(got[1]) == (0.25, 25.0)


def test_ordinal(spark):
    levels = ["1", "<0", "other"]
    assert column(
        spark, levels, "string", lambda c: labels.ordinal(c, labels.LEVEL_LABELS)
    ) == [3, 1, 0]
