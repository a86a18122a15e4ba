from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from snaplevel.operators import media as media_ops
from snaplevel.operators.series import SnapshotSeries
from snaplevel.plans import analyses as A
from snaplevel.sources import lookups, sinks, snapshots, text, workdir

HEADER = "gbifID\tbasisOfRecord\tlocality\tyear"
LINES = [
    '1\tPRESERVED_SPECIMEN\t"open quote\t1905',
    "2\tPRESERVED_SPECIMEN\tshort",
    "3\tFOSSIL_SPECIMEN\tlong\t1906\tsurplus\tmore",
    "4\tFOSSIL_SPECIMEN\t\t",
    "5\tPRESERVED_SPECIMEN\tback\\slash\t1907",
]


@pytest.fixture
def dump(tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join([HEADER, *LINES[:3]]) + "\n")
    (folder / "b.txt").write_text("\n".join([HEADER, *LINES[3:]]) + "\n")
    return str(folder)


def test_delimited_text(spark, dump):
    got = sorted(tuple(r) for r in text.read_delimited(spark, dump).collect())
    assert got == [
        ("1", "PRESERVED_SPECIMEN", '"open quote', "1905"),
        ("3", "FOSSIL_SPECIMEN", "long", "1906"),
        ("4", "FOSSIL_SPECIMEN", None, None),
        ("5", "PRESERVED_SPECIMEN", "back\\slash", "1907"),
    ]


def test_rejects_and_audit(spark, dump):
    assert [tuple(r) for r in text.capture_rejects(spark, dump).collect()] == [(LINES[1], 3, 4)]
    assert tuple(text.reject_audit(spark, dump).first()) == (4, 1, 0.2)


def test_ingest_split(spark, dump, tmp_path):
    target, rejects = str(tmp_path / "parquet"), str(tmp_path / "rejects")
    audit = text.ingest_split(spark, dump, target, rejects)
    assert tuple(audit.first()) == (4, 1, 0.2)
    back = text.read_ingested(spark, target, HEADER.split("\t"))
    assert {r.basisOfRecord: r.n for r in back.groupBy("basisOfRecord").agg(F.count("*").alias("n")).collect()} == {
        "PRESERVED_SPECIMEN": 2, "FOSSIL_SPECIMEN": 2
    }


def test_every_line_is_counted(spark, tmp_path):
    """Blank lines are rows of one empty field, and a line like the header is data but for the first."""
    one = tmp_path / "one.txt"
    one.write_text("identifier\nidentifier\n\nx\n")
    got = [r[0] for r in text.read_delimited(spark, str(one)).collect()]
    assert sorted(map(str, got)) == ["None", "identifier", "x"]
    assert tuple(text.reject_audit(spark, str(one)).first()) == (3, 0, 0.0)
    two = tmp_path / "two.txt"
    two.write_text("a\tb\n1\t2\n\na\tb\n")
    assert sorted(tuple(r) for r in text.read_delimited(spark, str(two)).collect()) == [("1", "2"), ("a", "b")]
    assert [(r.line, r.n_fields, r.n_expected) for r in text.capture_rejects(spark, str(two)).collect()] == [("", 1, 2)]
    out = [str(tmp_path / "parquet"), str(tmp_path / "rejects")]
    audit = text.ingest_split(spark, str(two), *out, by="a")
    assert tuple(audit.first())[:2] == (2, 1)
    assert sorted(tuple(r) for r in text.read_ingested(spark, out[0], ["a", "b"]).collect()) == [("1", "2"), ("a", "b")]


def test_files_of_one_dump_may_order_their_columns(spark, tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    (folder / "1.txt").write_text("a\tb\n1\t2\n")
    (folder / "2.txt").write_text("b\ta\n4\t3\nb\ta\n")
    (folder / "3.txt").write_text("")
    got = text.read_delimited(spark, str(folder))
    assert sorted((r.a, r.b) for r in got.collect()) == [("1", "2"), ("3", "4"), ("a", "b")]
    assert tuple(text.reject_audit(spark, str(folder)).first()) == (3, 0, 0.0)
    out = [str(tmp_path / "parquet"), str(tmp_path / "rejects")]
    assert tuple(text.ingest_split(spark, str(folder), *out, by="a").first()) == (3, 0, 0.0)
    assert text.read_ingested(spark, out[0], ["a", "b"]).count() == 3
    (folder / "4.txt").write_text("a\tc\n")
    with pytest.raises(ValueError, match="different columns"):
        text.read_delimited(spark, str(folder))


def test_ingest_scans_the_dump_once(spark, dump, tmp_path):
    """Whole lines are read by one job; the other reads of the text are of first lines."""
    target = str(tmp_path / "parquet")
    counts = {"accepted": 0, "rejected": 0}
    lines, names, n_headers = text._parts(spark, dump, None)[0]
    assert text._write_lines(lines, names, n_headers, target, "basisOfRecord", counts, True) == 0
    assert counts == {"accepted": 4, "rejected": 1}
    assert sorted(p.name for p in (tmp_path / "parquet").iterdir() if p.is_dir()) == ["accepted=false", "accepted=true"]


def test_line_ends(spark, tmp_path):
    path = tmp_path / "crlf.txt"
    path.write_bytes(b"a\tb\r\n1\tx\ry\r\n2\r\n3\tz\r\n")
    assert sorted(tuple(r) for r in text.read_delimited(spark, str(path)).collect()) == [
        ("1", "x\ry"), ("3", "z")
    ]
    assert [r.line for r in text.capture_rejects(spark, str(path)).collect()] == ["2"]


def test_ingest_of_a_dump_without_good_lines(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("a\tbasisOfRecord\n1\n2 \r x\n")
    out = [str(tmp_path / "parquet"), str(tmp_path / "rejects")]
    audit = text.ingest_split(spark, str(tmp_path / "bad.txt"), *out)
    assert tuple(audit.first()) == (0, 2, 1.0)


def test_media_joins(spark):
    occ = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z"), (None, "w")], "gbifID string, v string")
    media = spark.createDataFrame(
        [("1", "b"), ("1", "a"), ("2", None), (None, "lost"), ("9", "q")],
        "gbifID string, identifier string",
    )
    joined = media_ops.join_media(occ, media).collect()
    assert {(r.gbifID, r.v): r.multimediaIdentifier for r in joined} == {
        ("1", "x"): "a", ("2", "y"): None, ("3", "z"): None, (None, "w"): None
    }
    raw = sorted(map(tuple, media_ops.join_media_raw(occ, media).collect()), key=str)
    assert raw == sorted(
        [("1", "x", "a"), ("1", "x", "b"), ("2", "y", None), ("3", "z", None), (None, "w", None)],
        key=str,
    )


def test_heavy_id_of_the_record_side_is_split(spark):
    """One id holds a third of the records: AQE splits its partition over several tasks."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        occ = spark.range(0, 300_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("string").alias("gbifID"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        media = spark.range(0, 300_000, 1, 8).select(
            (F.col("id") % 1000).cast("string").alias("gbifID"),
            F.concat(F.lit("u"), F.col("id").cast("string")).alias("identifier"),
        )
        joined = media_ops.join_media(occ, media)
        assert len(joined.collect()) == 300_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SCORED = "gbifID long, MIDS_level tinyint, `mids:MIDS0A` boolean, snapshot_year int"
ROWS = [(1, 0, True, 2016), (1, 1, True, 2018), (2, -1, False, 2018)]


def test_dated_folders_make_a_series(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCORED)
    for year in (2018, 2016):
        part = df.where(F.col("snapshot_year") == year).drop("snapshot_year")
        part.write.parquet(str(tmp_path / f"set_{year}-01-01_key.parquet"))
    series = snapshots.read_series(spark, str(tmp_path))
    assert series.years == (2016, 2018)
    assert {r.snapshot_year: r.n for r in A.row_counts(series).collect()} == {2016: 1, 2018: 2}
    found = snapshots.discover_snapshots(spark, str(tmp_path)).collect()
    assert [r.snapshot_year for r in found] == [2016, 2018]


def test_two_dumps_of_one_year_stay_two_snapshots(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCORED).drop("snapshot_year")
    df.write.parquet(str(tmp_path / "set_2016-06-07.parquet"))
    df.limit(1).write.parquet(str(tmp_path / "faulty" / "set_2016-11-01.parquet"))
    assert snapshots.read_series(spark, f"file://{tmp_path}/").years == (2016,)
    assert [(r.dump, r.n) for r in snapshots.rows_per_dump(spark, str(tmp_path)).collect()] == [("set_2016-06-07.parquet", 3)]
    df.limit(2).write.parquet(str(tmp_path / "set_2016-11-01.parquet"))
    with pytest.raises(ValueError, match="several snapshots of one year"):
        snapshots.read_series(spark, str(tmp_path))
    got = snapshots.rows_per_dump(spark, str(tmp_path)).collect()
    assert sorted((r.dump, r.n) for r in got) == [("set_2016-06-07.parquet", 3), ("set_2016-11-01.parquet", 2)]


def test_snapshots_of_other_elements_are_refused(spark):
    df = spark.createDataFrame(ROWS, SCORED).drop("snapshot_year")
    with pytest.raises(ValueError, match="2018 lacks mids:MIDS1B"):
        snapshots.stack_snapshots({2016: df.withColumn("mids:MIDS1B", F.lit(True)), 2018: df})


def test_one_to_many_join_shuffles_the_records_once(spark):
    occ = spark.range(1000).select(F.col("id").cast("string").alias("gbifID"), F.col("id").alias("v"))
    media = spark.range(3000).select((F.col("id") % 700).cast("string").alias("gbifID"), F.col("id").cast("string").alias("identifier"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = media_ops.join_media_raw(occ, media)
        assert joined.count() == 3000 + 300
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.split("Initial Plan")[0].count("ReusedExchange") >= 1


def test_folder_without_dates_is_an_error(spark, tmp_path):
    spark.createDataFrame(ROWS, SCORED).write.parquet(str(tmp_path / "undated.parquet"))
    with pytest.raises(ValueError, match="no dated"):
        snapshots.read_series(spark, str(tmp_path))


def test_partitioned_series_prunes(spark, tmp_path):
    path = str(tmp_path / "scored")
    sinks.write_scored(spark.createDataFrame(ROWS, SCORED), path)
    series = snapshots.read_partitioned_series(spark, path)
    assert series.years == (2016, 2018)
    plan = series.select(2016)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_year" in plan


def test_stacked_snapshots(spark):
    df = spark.createDataFrame(ROWS, SCORED)
    parts = {y: df.where(F.col("snapshot_year") == y).drop("snapshot_year") for y in (2018, 2016)}
    stacked = snapshots.stack_snapshots(parts)
    assert stacked.years == (2016, 2018) and stacked.rows.count() == 3


def test_bucketed_table_needs_no_shuffle_on_the_id(spark):
    from snaplevel.operators import series as X

    spark.sql("DROP TABLE IF EXISTS scored_bucketed")
    try:
        sinks.save_bucketed(spark.createDataFrame(ROWS, SCORED), "scored_bucketed", 4)
        series = SnapshotSeries.of(spark.table("scored_bucketed"), [2016, 2018])
        matched = X.matched_levels(series)
        plan = matched._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert matched.count() == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS scored_bucketed")


def test_tsv_csv_json(spark, tmp_path):
    df = spark.createDataFrame(
        [(2016, 'say "hi", x', None), (2018, "plain", 1.5)], "snapshot_year int, t string, v double"
    )
    sinks.write_tsv(df, str(tmp_path / "tsv"))
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_json(df, str(tmp_path / "json"))
    expected = sorted(tuple(r) for r in df.collect())
    for back in (
        spark.read.schema(df.schema).csv(str(tmp_path / "tsv"), sep="\t", header=True, escape='"'),
        spark.read.schema(df.schema).csv(str(tmp_path / "csv"), header=True, escape='"'),
        spark.read.schema(df.schema).json(str(tmp_path / "json")).select(*df.columns),
    ):
        assert sorted(tuple(r) for r in back.collect()) == expected


def test_summaries_are_tagged_with_their_year(spark, tmp_path):
    for year in (2016, 2018):
        (tmp_path / f"set_{year}-06-07_x.parquet__simple.csv").write_text(
            "total_rows\tcolumn_name\ttrue_count\tfalse_count\ttrue_percentage\n"
            "4\t0A\t3\t1\t75\n4\t-1\t1\t\t25\n4\t0\t3\t\t75\n"
        )
    rows = lookups.read_summaries(spark, str(tmp_path) + "/*.csv")
    levels = A.levels_over_time(rows).orderBy("xpos").collect()
    assert [(r.year, r.level, r.true_count, r.xpos) for r in levels] == [
        (2016, "<0", 1, 1), (2016, "0", 3, 2), (2018, "<0", 1, 3), (2018, "0", 3, 4)
    ]
    totals = A.records_over_time(A.levels_over_time(rows)).orderBy("year").collect()
    assert [tuple(r) for r in totals] == [(2016, 4, 1, 2, 1.5), (2018, 4, 3, 4, 3.5)]


def test_lookup_reads_na_as_missing_unless_told_otherwise(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("Continent_Name,Two_Letter_Country_Code,x\nAfrica,NA,1\nEurope,BE,2\n")
    got = lookups.read_continents(spark, str(path)).collect()
    assert {tuple(r) for r in got} == {(None, "Africa"), ("BE", "Europe")}
    kept = lookups.read_lookup_csv(
        spark, str(path), {"countryCode": "Two_Letter_Country_Code"}, null_text=""
    )
    assert {r[0] for r in kept.collect()} == {"NA", "BE"}


def test_registry_and_kingdoms(spark, tmp_path):
    (tmp_path / "r.tsv").write_text(
        "Date (modified)\tDataset key\tDOI\n2016-06-07T13:36:38+00:00\t0004-16\t10.1/x\n"
    )
    assert [tuple(r) for r in lookups.read_registry(spark, str(tmp_path / "r.tsv")).collect()] == [
        (2016, "2016-06-07T13:36:38+00:00", "0004-16", "10.1/x")
    ]
    (tmp_path / "k.txt").write_text("phylum\tn\tkingdom\nChordata\t3\tAnimalia\n\t2\t\n")
    got = lookups.read_kingdoms(spark, str(tmp_path / "k.txt")).collect()
    assert {tuple(r) for r in got} == {("Chordata", "Animalia"), (None, None)}


class FakeSession:
    def __init__(self, shared, master):
        self.conf = {workdir.CHECKPOINT_CONF: shared} if shared else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_work_folder_follows_the_cluster_setting():
    shared = FakeSession("file:/shared/x/", "spark://host:7077")
    first, second = workdir.work_folder(shared, "a"), workdir.work_folder(shared, "a")
    assert first.startswith("file:/shared/x/a-") and first != second
    assert workdir.work_folder(FakeSession(None, "local[2]"), "a")
    with pytest.raises(ValueError, match="executors share"):
        workdir.work_folder(FakeSession(None, "spark://host:7077"), "a")
