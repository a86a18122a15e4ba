from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplevel import schema as S
from snaplevel.functions import presence
from snaplevel.mappings import default_mapping
from snaplevel.operators import scoring

FULL = {
    "gbifID": "1", "datasetKey": "d", "catalogNumber": "c", "institutionID": "i",
    "scientificName": "s", "taxonKey": "9", "preparations": "p", "license": "l", "modified": "m",
    "locality": "x", "decimalLatitude": "1", "decimalLongitude": "2", "locationID": "loc",
    "recordedBy": "r", "recordedByID": "rid", "year": "1905", "recordNumber": "7",
    "multimediaIdentifier": "u", "identifiedByID": "idby", "countryCode": "BE", "phylum": "P",
}


def frame(spark, *rows):
    names = list(dict.fromkeys(k for r in rows for k in r))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([[r.get(n) for n in names] for r in rows], schema)


def levels(df, mapping=None):
    return [r[S.LEVEL] for r in scoring.score_records(df, mapping).orderBy("gbifID").collect()]


def test_output_schema(spark):
    scored = scoring.score_records(frame(spark, FULL))
    expected = S.scored_schema(default_mapping().flags)
    assert [(f.name, f.dataType) for f in scored.schema] == [
        (f.name, f.dataType) for f in expected
    ]


def test_levels_are_cumulative(spark):
    without = lambda i, *names: {**{k: v for k, v in FULL.items() if k not in names}, "gbifID": i}
    df = frame(
        spark,
        without("1"),
        without("2", "identifiedByID"),
        without("3", "recordNumber"),
        without("4", "preparations"),
        without("5", "catalogNumber"),  # rich in level 3, poor in level 0
    )
    assert levels(df) == [3, 2, 1, 0, -1]


def test_absent_column_counts_as_missing(spark):
    df = frame(spark, {k: v for k, v in FULL.items() if k != "license"})
    row = scoring.score_records(df).first()
    assert row["mids:MIDS1License"] is False and row[S.LEVEL] == 0


def test_misnamed_media_column_gives_no_media_and_no_error(spark):
    renamed = {("mm" if k == "multimediaIdentifier" else k): v for k, v in FULL.items()}
    row = scoring.score_records(frame(spark, renamed)).first()
    assert row["mids:MIDS2Media"] is False and row["mids:MIDS3MediaID"] is False


def test_column_names_match_without_regard_to_case(spark):
    row = scoring.score_records(
        frame(spark, {("gbifid" if k == "gbifID" else k.upper()): v for k, v in FULL.items()})
    ).first()
    assert row[S.LEVEL] == 3 and row["gbifID"] == 1 and row["countryCode"] == "BE"


def test_boolean_media_column(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "gbifID long, multimedia boolean")
    text = presence.media_flag_to_text(df).orderBy("gbifID")
    assert [r["multimedia"] for r in text.collect()] == ["T", None, None]
    scored = scoring.score_records(df, default_mapping("multimedia")).orderBy("gbifID")
    assert [r["mids:MIDS3MediaID"] for r in scored.collect()] == [True, False, False]


def test_years_that_are_no_smallint_become_null_and_are_counted(spark):
    texts = ["1905.5", "99999", "", "1905", "unknown:undigitized"]
    df = frame(spark, *[{**FULL, "gbifID": str(i), "year": y} for i, y in enumerate(texts)])
    scored = scoring.score_records(df).orderBy("gbifID")
    assert [r["year"] for r in scored.collect()] == [None, None, None, 1905, None]
    assert [r["mids:MIDS2DateCollected"] for r in scored.collect()] == [
        True, True, False, True, False
    ]
    assert scoring.cast_casualties(df).first().asDict() == {"gbifID": 0, "year": 2}


def test_output_columns_are_cleaned_only_where_mapped(spark):
    df = frame(spark, {**FULL, "countryCode": "unknown:undigitized", "phylum": ""})
    row = scoring.score_records(df).first()
    assert row["countryCode"] is None and row["phylum"] == ""


def test_only_mapped_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "raw")
    frame(spark, FULL).withColumn("remarks", F.lit("long text")).write.parquet(path)
    plan = scoring.score_records(spark.read.parquet(path))._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("remarks" not in line for line in scans)


def test_scoring_needs_no_shuffle(spark):
    plan = scoring.score_records(frame(spark, FULL))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("n", [18, 63, 64, 130])
def test_packed_flags(spark, n):
    flags = [f"f{i}" for i in range(n)]
    numbers = (0, 5, 2**n - 1, 2 ** (n - 1), int("10" * (n // 2), 2))
    rows = [[(k >> i) & 1 == 1 for i in range(n)] for k in numbers]
    df = spark.createDataFrame(rows, flags).withColumn("p", presence.pack_flags(flags))
    got = df.select("p", *[presence.packed_flag(F.col("p"), i) for i in range(n)]).collect()
    assert all(len(r[0]) == -(-n // 63) for r in got)
    assert [list(r)[1:] for r in got] == [[(k >> i) & 1 for i in range(n)] for k in numbers]


def test_column_names_with_hyphens(spark):
    from snaplevel.mappings import Alternative, Element, MappingSet

    columns = ("Gathering-LatitudeDecimal", "Gathering-LongitudeDecimal")
    mapping = MappingSet(
        (Element(0, "QuantitativeLocation", (Alternative(columns),)),), {columns[0]: ("",)}
    )
    df = frame(spark, {"gbifID": "1", columns[0]: "1", columns[1]: "2"},
               {"gbifID": "2", columns[0]: "", columns[1]: "2"})
    assert levels(df, mapping) == [3, -1]  # levels without elements are reached with the one below


def test_a_filter_over_flags_and_level_plans_quickly(spark):
    """Flags and level share their rules; the optimizer must not combine them exhaustively."""
    import time

    scored = scoring.score_records(frame(spark, FULL))
    grouped = scored.groupBy(S.LEVEL, *map(S.quoted, default_mapping().flags)).count()
    start = time.monotonic()
    grouped.where("`count` > 0")._jdf.queryExecution().optimizedPlan()
    assert time.monotonic() - start < 20
