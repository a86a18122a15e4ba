"""Every operator and analysis as a query over the given tables: name to (spark, folder) function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import bins, labels, presence
from snaplevel.functions.shares import group_total, percent, with_joined_total
from snaplevel.mappings import default_mapping
from snaplevel.operators import cube, history, masks, paths, renames, scoring, sketches, slices, summary
from snaplevel.operators import media as media_ops
from snaplevel.operators import series as X
from snaplevel.operators.series import NEW, OLD
from snaplevel.plans import analyses as A
from snaplevel.registry import tables
from snaplevel.registry.tables import LAST_YEAR
from snaplevel.sources import lookups, repair, sinks, snapshots, text
from snaplevel.sources.workdir import work_folder
from snaplevel.streaming import changes, incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Size class bounds that spread the small data sets of the test tables over all classes.
SIZE_BOUNDS = (230, 250, 1000)
SUBSET_PHYLUM = "3-MEDIUM"
FROM_YEAR, TO_YEAR = 1998, 1999
# Columns whose bits the query of the masks shows.
MASKED = ("catalogNumber", "institutionID", "taxonKey", "locality", "year", "recordNumber", "multimediaIdentifier")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _series(spark: SparkSession, folder: str) -> X.SnapshotSeries:
    return tables.scored_series(spark, folder)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return _series(spark, folder).rows


def _last(spark: SparkSession, folder: str) -> DataFrame:
    return tables.scored_series(spark, folder, [LAST_YEAR]).rows


# --- scans, sources, sinks --------------------------------------------------------------------


def dump_line(columns: list[str], broken: bool = False) -> Column:
    """A raw record as a tab-separated line; some are malformed.

    By kind and phylum: lines that lack their last field, lines with a surplus field, and lines with
    a lone quote character. With ``broken`` some localities hold one or two line feeds.
    """
    locality = F.when(
        (F.col("phylum") == "2-HIGH") & F.col("locality").isNotNull(), F.concat(F.lit('"'), F.col("locality"))
    )
    if broken:
        fed = F.when(F.col("phylum") == "3-MEDIUM", "some\nwhere").when(F.col("phylum") == "1-URGENT", "some\n\nwhere")
        locality = F.when(F.col("locality").isNotNull() & fed.isNotNull(), fed).otherwise(locality)
    quoted = [
        F.coalesce(locality, F.col(c), F.lit("")) if c == "locality" else F.coalesce(F.col(c), F.lit(""))
        for c in columns
    ]
    low = F.col("phylum") == "5-LOW"
    return (
        F.when(low & (F.col("basisOfRecord") == "HUMAN_OBSERVATION"),
               F.concat_ws("\t", *quoted[:-1]))
        .when(low & (F.col("basisOfRecord") == "FOSSIL_SPECIMEN"),
              F.concat_ws("\t", *quoted, F.lit("surplus")))
        .otherwise(F.concat_ws("\t", *quoted))
    )


def _write_dump(spark: SparkSession, folder: str, broken: bool = False) -> str:
    """The records as a text dump of files with a header line each, one kind of them in another order.

    The number of files grows with the records, so that no task writes more than about DUMP_ROWS.
    """
    raw = tables.raw_occurrences(spark, folder)
    path = work_folder(spark, "dump")
    turned = tables.turned(raw.columns)
    parts = tables.parts_of(spark, folder, tables.DUMP_FILES * tables.DUMP_ROWS)
    number = F.col("catalogNumber").cast("bigint")
    file = F.pmod(number, F.lit(tables.DUMP_FILES))
    lines = raw.select(
        file.alias("file"),
        F.pmod(F.xxhash64(number), F.lit(parts)).cast("bigint").alias("part"),
        F.when(file == 0, dump_line(turned, broken)).otherwise(dump_line(raw.columns, broken)).alias("value"),
    )
    names = F.when(F.col("file") == 0, "\t".join(turned)).otherwise("\t".join(raw.columns))
    every = spark.range(tables.DUMP_FILES * parts).selectExpr(f"id % {tables.DUMP_FILES} AS file", f"id div {tables.DUMP_FILES} AS part")
    headers = every.withColumn("value", names)
    both = headers.withColumn("_n", F.lit(0)).unionByName(lines.withColumn("_n", F.lit(1)))
    sorted_files = both.repartition("file", "part").sortWithinPartitions("file", "part", "_n")
    sorted_files.select("file", "part", "value").write.partitionBy("file", "part").text(path)
    return path


@query
def read_dwca_text(spark, folder):
    return text.read_delimited(spark, _write_dump(spark, folder))


@query
def capture_rejects(spark, folder):
    return text.capture_rejects(spark, _write_dump(spark, folder))


@query
def reject_audit(spark, folder):
    return text.reject_audit(spark, _write_dump(spark, folder))


@query
def read_multimedia_text(spark, folder):
    media = tables.media(spark, folder)
    path = work_folder(spark, "media")
    media.select(
        F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in media.columns]).alias("value")
    ).write.text(path)
    return text.read_multimedia(spark, path, media.columns)


@query
def ingest_split(spark, folder):
    path = _write_dump(spark, folder)
    return text.ingest_split(
        spark, path, work_folder(spark, "accepted"), work_folder(spark, "rejects")
    )


@query
def write_partitioned(spark, folder):
    target = work_folder(spark, "occurrences")
    sinks.write_partitioned(tables.raw_occurrences(spark, folder), target, "basisOfRecord")
    return summary.count_by_key(spark.read.parquet(target), "basisOfRecord")


@query
def read_partitioned(spark, folder):
    target = work_folder(spark, "occurrences")
    raw = tables.raw_occurrences(spark, folder)
    sinks.write_partitioned(raw, target, "basisOfRecord")
    one = spark.read.parquet(target).where(F.col("basisOfRecord") == "PRESERVED_SPECIMEN")
    return one.select(*raw.columns)


@query
def scan_snapshot(spark, folder):
    rows = snapshots.read_snapshot(spark, f"{folder}/orders.parquet", LAST_YEAR)
    return rows.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", S.SNAPSHOT_YEAR
    )


@query
def scan_projected(spark, folder):
    raw = tables.raw_occurrences(spark, folder)
    return scoring.scan_projected(raw, default_mapping())


def _incoming(spark: SparkSession, folder: str, shares: int, per_batch: int | None) -> DataFrame:
    """Raw rows of all snapshots, in equal shares, as a stream that picks up ``per_batch`` shares at a time.

    A share is as many files as keep each, which one task writes, to the snapshots of about SHARE_ORDERS orders.
    """
    raw = tables.raw_series(spark, folder)
    target = work_folder(spark, "incoming")
    files = tables.parts_of(spark, folder, shares * tables.SHARE_ORDERS)
    raw.repartition(shares * files).write.parquet(target)
    return incremental.read_stream(spark, target, raw.schema, per_batch and per_batch * files)


def _scored_by_stream(
    spark: SparkSession, folder: str, shares: int, per_batch: int | None
) -> DataFrame:
    target = work_folder(spark, "scored")
    records = _incoming(spark, folder, shares, per_batch)
    scored = incremental.score_stream(records, extra=[S.SNAPSHOT_YEAR])
    incremental.run_scoring(scored, target, work_folder(spark, "progress"))
    return spark.read.schema(scored.schema).parquet(target)


@query
def score_batches(spark, folder):
    return _scored_by_stream(spark, folder, shares=4, per_batch=2)


@query
def stream_score(spark, folder):
    return _scored_by_stream(spark, folder, shares=2, per_batch=None)


@query
def stream_level_counts(spark, folder):
    records = _incoming(spark, folder, 4, 2)
    scored = incremental.score_stream(records, extra=[S.SNAPSHOT_YEAR])
    target = work_folder(spark, "level-counts")
    incremental.run_level_counts(
        incremental.level_counts_stream(scored), target, work_folder(spark, "progress")
    )
    return incremental.read_level_counts(spark, target)


def _write_dated(spark: SparkSession, folder: str) -> str:
    """One dated folder per snapshot."""
    target = work_folder(spark, "snapshots")
    dated = _rows(spark, folder).withColumn(
        "dump", F.concat(F.col(S.SNAPSHOT_YEAR).cast("string"), F.lit("-01-01"))
    )
    sinks.write_partitioned(dated.drop(S.SNAPSHOT_YEAR), target, "dump")
    return target


@query
def discover_snapshots(spark, folder):
    found = snapshots.discover_snapshots(spark, _write_dated(spark, folder))
    return found.select(S.SNAPSHOT_YEAR, F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


@query
def union_snapshots(spark, folder):
    return A.row_counts(snapshots.read_series(spark, _write_dated(spark, folder)))


@query
def sort_snapshots(spark, folder):
    return A.row_counts(_series(spark, folder)).orderBy(S.SNAPSHOT_YEAR)


@query
def write_scored(spark, folder):
    target = work_folder(spark, "scored")
    sinks.write_scored(tables.scored_series(spark, folder, dealt=True).rows, target)
    return A.row_counts(snapshots.read_partitioned_series(spark, target))


@query
def select_snapshot(spark, folder):
    rows = _series(spark, folder).select(FROM_YEAR)
    return rows.select(S.RECORD_ID, S.DATASET, S.LEVEL, S.SNAPSHOT_YEAR)


@query
def read_lookup_csv(spark, folder):
    path = work_folder(spark, "continents")
    continents = tables.continents(spark, folder)
    sinks.write_csv(
        continents.select(
            F.col(S.COUNTRY).alias("Two_Letter_Country_Code"),
            F.col("continent").alias("Continent_Name"),
        ),
        path,
    )
    return slices.continent_completeness(
        _rows(spark, folder), lookups.read_continents(spark, path), tables.CONTINENTS
    )


@query
def read_summaries(spark, folder):
    path = work_folder(spark, "summaries")
    tagged = A.summaries_of(_series(spark, folder)).withColumn(
        "dump", F.concat(F.col("year").cast("string"), F.lit("-01-01"))
    )
    tagged.drop("year").write.partitionBy("dump").csv(
        path, sep="\t", header=True, nullValue="", emptyValue=""
    )
    return lookups.read_summaries(spark, f"{path}/*")


@query
def read_mapping(spark, folder):
    path = work_folder(spark, "mapping")
    rows = default_mapping().to_rows()
    sinks.write_tsv(spark.createDataFrame(rows).select(*rows[0]).coalesce(1), path)
    raw = tables.raw_series(spark, folder)
    scored = scoring.score_records(raw, lookups.read_mapping(spark, path), [S.SNAPSHOT_YEAR])
    return summary.level_distribution(scored, [S.SNAPSHOT_YEAR])


@query
def read_registry(spark, folder):
    path = work_folder(spark, "registry")
    dates = tables.raw_series(spark, folder, with_media=False).select(S.SNAPSHOT_YEAR).distinct()
    year = F.col(S.SNAPSHOT_YEAR).cast("string")
    sinks.write_tsv(
        dates.select(
            F.concat(year, F.lit("-01-01T00:00:00")).alias("Date (modified)"),
            F.concat(F.lit("key-"), year).alias("Dataset key"),
            F.concat(F.lit("10.0000/dl."), year).alias("DOI"),
        ).coalesce(1),
        path,
    )
    counts = A.row_counts(_series(spark, folder))
    registry = lookups.read_registry(spark, path)
    return registry.join(counts, S.SNAPSHOT_YEAR).select(S.SNAPSHOT_YEAR, "key", "doi", "n")


@query
def write_tsv(spark, folder):
    path = work_folder(spark, "summary")
    sinks.write_tsv(A.snapshot_summary(_series(spark, folder), LAST_YEAR), path)
    return spark.read.schema(lookups.SUMMARY_SCHEMA).csv(path, sep="\t", header=True)


@query
def write_csv(spark, folder):
    path = work_folder(spark, "trend")
    counts = A.element_trend_counts(_series(spark, folder))
    sinks.write_csv(counts, path)
    return spark.read.schema(counts.schema).csv(path, header=True)


@query
def write_json(spark, folder):
    path = work_folder(spark, "datasets")
    counts = A.dataset_counts(_series(spark, folder))
    sinks.write_json(counts, path)
    return spark.read.schema(counts.schema).json(path)


# --- projections, predicates, scalar functions ------------------------------------------------

CLEANED = ["gbifID", "scientificName", "taxonKey", "year", "countryCode", "institutionID"]


@query
def null_sentinels(spark, folder):
    raw = tables.raw_series(spark, folder, with_media=False)
    cleaned = presence.null_sentinels(raw, default_mapping().sentinels)
    return cleaned.select(*CLEANED, S.SNAPSHOT_YEAR)


@query
def add_missing_columns(spark, folder):
    raw = tables.raw_occurrences(spark, folder).select("gbifID", "locality")
    return presence.add_missing_columns(raw, ["locality", "footprintWKT", "footprintSRS"])


@query
def media_flag_to_text(spark, folder):
    flagged = tables.media(spark, folder).select(
        "gbifID", F.col("identifier").isNotNull().alias("multimedia")
    )
    return summary.count_by_key(presence.media_flag_to_text(flagged), "gbifID", "multimedia")


@query
def compile_rules(spark, folder):
    rows = _rows(spark, folder)
    return rows.select(
        S.RECORD_ID, S.SNAPSHOT_YEAR, *[F.col(S.quoted(f)) for f in S.flag_columns(rows)]
    )


@query
def all_of_row(spark, folder):
    rows = _rows(spark, folder)
    up_to_1 = [f for f in S.flag_columns(rows) if f[len(S.LEVEL_PREFIX)] in "01"]
    return rows.select(
        S.RECORD_ID, S.SNAPSHOT_YEAR, presence.all_of_row(up_to_1).alias("complete")
    )


@query
def strip_class_prefix(spark, folder):
    pages = tables.table(spark, folder, "pages")
    return pages.select("page_id", presence.strip_class_prefix(F.col("url")).alias("rest"))


@query
def score_level(spark, folder):
    return _rows(spark, folder).select(S.RECORD_ID, S.SNAPSHOT_YEAR, S.LEVEL)


@query
def cast_output(spark, folder):
    raw = tables.raw_series(spark, folder, with_media=False)
    cleaned = scoring.clean_properties(raw, default_mapping()).withColumn(S.LEVEL, F.lit(-1))
    return scoring.cast_output(cleaned, [], [S.SNAPSHOT_YEAR])


@query
def cast_casualties(spark, folder):
    return scoring.cast_casualties(tables.raw_series(spark, folder, with_media=False))


@query
def select_rename(spark, folder):
    columns = [S.RECORD_ID, S.DATASET, S.LEVEL, S.PHYLUM, S.SNAPSHOT_YEAR]
    rows = _rows(spark, folder).select(*columns)
    return rows.withColumnRenamed(S.LEVEL, "MIDS_from").drop(S.PHYLUM)


@query
def filter_eq(spark, folder):
    pairs = X.matched_levels(_series(spark, folder))
    return pairs.where((F.col(OLD) == 1) & (F.col(NEW) == 0))


@query
def filter_neq(spark, folder):
    pairs = X.matched_levels(_series(spark, folder))
    return pairs.where(F.col(OLD) != F.col(NEW))


@query
def filter_lt(spark, folder):
    columns = [S.RECORD_ID, S.DATASET, "from_year", "to_year", OLD, NEW, "change", "n"]
    return A.declines(_series(spark, folder)).select(*columns)


@query
def filter_in(spark, folder):
    animals = [p for p, k in tables.KINGDOM_OF if k == "Animalia"]
    rows = _rows(spark, folder).where(F.col(S.PHYLUM).isin(animals))
    return summary.count_by_key(rows, S.SNAPSHOT_YEAR, S.PHYLUM)


@query
def filter_not_null(spark, folder):
    rows = _rows(spark, folder).where(F.col(S.COUNTRY).isNotNull())
    return summary.count_by_key(rows, S.SNAPSHOT_YEAR)


@query
def subset_levels(spark, folder):
    rows = _rows(spark, folder).where(F.col(S.PHYLUM) == SUBSET_PHYLUM)
    return summary.level_distribution(rows, [S.SNAPSHOT_YEAR])


@query
def size_class(spark, folder):
    return slices.dataset_sizes(_rows(spark, folder), SIZE_BOUNDS)


@query
def year_group(spark, folder):
    rows = _rows(spark, folder)
    group = bins.year_group(F.col(S.YEAR)).alias("year_group")
    return summary.count_by_key(rows, S.SNAPSHOT_YEAR, group)


@query
def element_group(spark, folder):
    trend = A.element_trend_counts(_series(spark, folder))
    group = labels.element_group(F.col("element"))
    return trend.select(S.SNAPSHOT_YEAR, "element", group.alias("mids_group"), "true_count")


def _labelled(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    counts = A.transition_counts(_series(spark, folder))
    return counts.select("interval", OLD, NEW, "n_records", *[c.alias(n) for n, c in columns.items()])


@query
def transition_label(spark, folder):
    return _labelled(spark, folder, transition=labels.transition_label(F.col(OLD), F.col(NEW)))


@query
def change_status(spark, folder):
    return _labelled(spark, folder, status=labels.change_status(F.col(OLD), F.col(NEW)))


@query
def change_direction(spark, folder):
    changed = _labelled(spark, folder, direction=labels.change_direction(F.col(OLD), F.col(NEW)))
    return changed.where(F.col(OLD) != F.col(NEW))


@query
def level_change(spark, folder):
    change = labels.level_change(F.col(OLD), F.col(NEW))
    return _labelled(spark, folder, change=change, drop_size=F.abs(change))


@query
def interval_label(spark, folder):
    series = _series(spark, folder)
    years = X.interval_columns(series)
    pairs = X.matched_levels(series).groupBy(S.SNAPSHOT_IDX).agg(F.sum("n").alias("n"))
    return pairs.select(labels.interval_label(*years).alias("interval"), "n")


@query
def strip_label(spark, folder):
    rows = _rows(spark, folder)
    wide = summary.element_counts(rows)
    long = summary.unpivot_elements(wide, ["total_rows"], S.flag_columns(rows))
    name = F.col("column_name")
    return long.select(
        labels.strip_element_prefix(name).alias("element"),
        labels.strip_level_prefix(name).alias("label"),
        "true_count",
    )


@query
def split_label(spark, folder):
    name = F.col("column_name")
    return summary.element_table(_rows(spark, folder)).select(
        labels.label_level(name).alias("level"),
        labels.label_element(name).alias("element"),
        "true_count",
    )


@query
def separate_key(spark, folder):
    counts = summary.count_by_key(_rows(spark, folder), S.SNAPSHOT_YEAR, S.LEVEL)
    keyed = counts.select(
        labels.year_level_key(F.col(S.SNAPSHOT_YEAR), F.col(S.LEVEL)).alias("xlab"), "n"
    )
    year, level = labels.separate_key(F.col("xlab"))
    return keyed.select("xlab", year.alias("year"), level.alias("level"), "n")


@query
def percent_label(spark, folder):
    counts = summary.count_by_key(_rows(spark, folder), S.SNAPSHOT_YEAR, S.DATASET, S.LEVEL)
    share = percent(F.col("n"), group_total("n", [S.SNAPSHOT_YEAR, S.DATASET]))
    return counts.withColumn("label", labels.percent_label(share))


@query
def parse_snapshot_year(spark, folder):
    orders = tables.table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    path = F.concat(F.lit("outputs/1001-01-01/set_"), day, F.lit("_0004071.parquet"))
    year = labels.parse_snapshot_year(path).alias("year")
    return summary.count_by_key(orders, year)


@query
def wrap_label(spark, folder):
    part = tables.table(spark, folder, "part")
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return part.select("p_partkey", labels.wrap_label(name).alias("label"))


@query
def level_order(spark, folder):
    counts = summary.count_by_key(
        slices.dataset_sizes(_rows(spark, folder), SIZE_BOUNDS), S.SNAPSHOT_YEAR, "size_class"
    )
    position = labels.ordinal(F.col("size_class"), bins.SIZE_CLASSES)
    return counts.withColumn("position", position).orderBy(S.SNAPSHOT_YEAR, "position")


# --- joins ------------------------------------------------------------------------------------


@query
def join_media(spark, folder):
    raw = tables.raw_occurrences(spark, folder)
    joined = media_ops.join_media(raw, tables.media(spark, folder))
    return joined.select("gbifID", "datasetKey", "phylum", "multimediaIdentifier")


@query
def join_media_raw(spark, folder):
    raw = tables.raw_occurrences(spark, folder).select("gbifID", "datasetKey", "phylum")
    return media_ops.join_media_raw(raw, tables.media(spark, folder))


@query
def any_identifier(spark, folder):
    return media_ops.any_identifier(tables.media(spark, folder))


@query
def new_records(spark, folder):
    series = _series(spark, folder)
    return X.new_records(series.select(TO_YEAR), series.select(FROM_YEAR))


@query
def new_rows_of_series(spark, folder):
    return X.new_rows_of_series(_series(spark, folder)).select(
        S.RECORD_ID, S.SNAPSHOT_YEAR, S.LEVEL, S.DATASET
    )


@query
def cohort_ids(spark, folder):
    series = _series(spark, folder)
    new = X.new_observations(series, empty_ids_match=True)
    return new.select(S.RECORD_ID, series.year_at(F.col(S.SNAPSHOT_IDX)).alias("cohort_year"), "n")


@query
def match_snapshots(spark, folder):
    series = _series(spark, folder)
    from_year, to_year = X.interval_columns(series)
    return X.matched_levels(series, S.DATASET).select(
        S.RECORD_ID, S.DATASET, from_year.alias("from_year"), to_year.alias("to_year"), OLD, NEW, "n"
    )


@query
def follow_base_cohort(spark, folder):
    series = _series(spark, folder)
    year = series.year_at(F.col(S.SNAPSHOT_IDX)).alias(S.SNAPSHOT_YEAR)
    return X.base_cohort(series).select(year, S.LEVEL, "n")


@query
def follow_cohorts(spark, folder):
    series = _series(spark, folder)
    return X.intake_cohorts(series).select(
        series.year_at(F.col("cohort_idx")).alias("cohort_year"),
        series.year_at(F.col(S.SNAPSHOT_IDX)).alias(S.SNAPSHOT_YEAR),
        S.LEVEL,
        "n",
    )


@query
def join_size_class(spark, folder):
    rows = _rows(spark, folder).select(S.RECORD_ID, S.DATASET, S.LEVEL, S.SNAPSHOT_YEAR)
    return slices.join_size_class(rows, SIZE_BOUNDS)


@query
def join_totals(spark, folder):
    trend = A.element_trend_fraction(_series(spark, folder))
    return trend.select(S.SNAPSHOT_YEAR, "element", summary.TRUE, "total_records")


@query
def join_continent(spark, folder):
    rows = _rows(spark, folder)
    counts = summary.count_by_key(rows, S.SNAPSHOT_YEAR, S.COUNTRY)
    return counts.join(tables.continents(spark, folder), S.COUNTRY, "left")


@query
def join_kingdom(spark, folder):
    rows = slices.of_kingdom(_rows(spark, folder), tables.kingdoms(spark), "Animalia")
    return rows.select(S.RECORD_ID, S.PHYLUM, S.LEVEL, S.SNAPSHOT_YEAR)


# --- aggregations, windows, sorts, reshaping --------------------------------------------------


@query
def level_distribution(spark, folder):
    return summary.level_distribution(_rows(spark, folder), [S.SNAPSHOT_YEAR])


@query
def element_counts(spark, folder):
    return summary.element_counts(_rows(spark, folder), [S.SNAPSHOT_YEAR])


@query
def snapshot_totals(spark, folder):
    return summary.snapshot_totals(_rows(spark, folder))


@query
def row_counts(spark, folder):
    return A.row_counts(_series(spark, folder))


@query
def count_by_key(spark, folder):
    return summary.count_by_key(_rows(spark, folder), S.SNAPSHOT_YEAR, S.PHYLUM)


@query
def year_totals(spark, folder):
    return A.records_over_time(A.levels_over_time(A.summaries_of(_series(spark, folder))))


@query
def distinct_elements(spark, folder):
    return summary.elements_per_level(summary.element_table(_rows(spark, folder)))


@query
def column_total(spark, folder):
    counts = A.declining_datasets_by_interval(_series(spark, folder))
    return with_joined_total(
        counts, "n_declined_specimens", ["from_year", "to_year"], "total_declined"
    )


@query
def repeated_ids(spark, folder):
    return X.repeated_ids(_series(spark, folder))


@query
def share_of_total(spark, folder):
    counts = summary.count_by_key(_rows(spark, folder), S.LEVEL)
    return counts.withColumn("percent", percent(F.col("n"), group_total("n", [])))


@query
def share_of_group(spark, folder):
    counts = summary.count_by_key(_rows(spark, folder), S.PHYLUM, S.LEVEL)
    return counts.withColumn("percent", percent(F.col("n"), group_total("n", [S.PHYLUM])))


@query
def largest_per_group(spark, folder):
    counts = summary.count_by_key(_rows(spark, folder), S.SNAPSHOT_YEAR, S.DATASET)
    named = counts.where(F.col(S.DATASET).isNotNull())
    return summary.largest_per_group(named, [S.SNAPSHOT_YEAR], "n", S.DATASET)


@query
def row_position(spark, folder):
    return A.levels_over_time(A.summaries_of(_series(spark, folder))).select("year", "level", "xpos")


@query
def sort_levels(spark, folder):
    levels = A.levels_over_time(A.summaries_of(_series(spark, folder)))
    return levels.orderBy("year", labels.ordinal(F.col("level"), labels.LEVEL_LABELS))


@query
def previous_snapshot(spark, folder):
    series = _series(spark, folder)
    marked = X.observations(series).withColumn("is_new", X.is_new(empty_ids_match=True))
    year = series.year_at(F.col(S.SNAPSHOT_IDX)).alias(S.SNAPSHOT_YEAR)
    return marked.groupBy(year, "is_new").agg(F.sum("n").alias("n"))


@query
def rank_declines(spark, folder):
    return A.declining_datasets(_series(spark, folder))


@query
def rank_declines_by_interval(spark, folder):
    return A.declining_datasets_by_interval(_series(spark, folder))


@query
def top_declining(spark, folder):
    return A.top_level_drop(_series(spark, folder), 2000, 2001, old_level=0, new_level=-1)


@query
def union_groups(spark, folder):
    names = list(slices.TARGET_KINGDOMS)
    return slices.summary_for_kingdoms(_rows(spark, folder), tables.kingdoms(spark), names, [S.SNAPSHOT_YEAR])


@query
def stack_elements_levels(spark, folder):
    return summary.stack_elements_levels(_rows(spark, folder), [S.SNAPSHOT_YEAR])


@query
def unpivot_elements(spark, folder):
    return summary.element_table(_rows(spark, folder), [S.SNAPSHOT_YEAR])


@query
def true_false_long(spark, folder):
    return summary.true_false_long(summary.element_table(_rows(spark, folder), [S.SNAPSHOT_YEAR]))


# --- analyses ---------------------------------------------------------------------------------


@query
def score_records(spark, folder):
    return _rows(spark, folder)


@query
def snapshot_summary(spark, folder):
    return A.snapshot_summary(_series(spark, folder), LAST_YEAR)


@query
def snapshot_summary_for_kingdom(spark, folder):
    return slices.summary_for_kingdom(
        _rows(spark, folder), tables.kingdoms(spark), "Animalia", [S.SNAPSHOT_YEAR]
    )


@query
def levels_over_time(spark, folder):
    return A.levels_over_time(A.summaries_of(_series(spark, folder)))


@query
def records_over_time(spark, folder):
    return A.records_over_time(A.levels_over_time(A.summaries_of(_series(spark, folder))))


@query
def new_record_levels(spark, folder):
    return A.new_record_levels(_series(spark, folder))


@query
def element_trend_counts(spark, folder):
    return A.element_trend_counts(_series(spark, folder))


@query
def element_trend_fraction(spark, folder):
    return A.element_trend_fraction(_series(spark, folder))


@query
def new_record_elements(spark, folder):
    return A.new_record_elements(_series(spark, folder))


@query
def change_status_by_interval(spark, folder):
    return A.change_status_by_interval(_series(spark, folder))


@query
def base_cohort_levels(spark, folder):
    return A.base_cohort_levels(_series(spark, folder))


@query
def intake_cohort_levels(spark, folder):
    return A.intake_cohort_levels(_series(spark, folder), last_cohort_year=LAST_YEAR - 1)


@query
def cohort_entry_levels(spark, folder):
    return A.cohort_entry_levels(
        A.intake_cohort_levels(_series(spark, folder), last_cohort_year=LAST_YEAR - 1)
    )


@query
def level_transitions(spark, folder):
    return A.level_transitions(_series(spark, folder))


@query
def largest_transition(spark, folder):
    return A.largest_transition(_series(spark, folder))


@query
def direction_summary(spark, folder):
    return A.direction_summary(_series(spark, folder))


@query
def declining_datasets(spark, folder):
    return A.declining_datasets(_series(spark, folder))


@query
def declining_datasets_by_interval(spark, folder):
    return A.declining_datasets_by_interval(_series(spark, folder))


@query
def decline_severity(spark, folder):
    return A.decline_severity(_series(spark, folder))


@query
def top_level_drop(spark, folder):
    return A.top_level_drop(_series(spark, folder), FROM_YEAR, TO_YEAR)


@query
def levels_by_dataset_size(spark, folder):
    return slices.levels_by_dataset_size(_rows(spark, folder), SIZE_BOUNDS)


@query
def kingdom_completeness(spark, folder):
    return slices.kingdom_completeness(_rows(spark, folder), tables.kingdoms(spark))


@query
def kingdom_completeness_one_snapshot(spark, folder):
    return slices.with_false_count(
        slices.kingdom_completeness(
            _last(spark, folder), tables.kingdoms(spark), lookup_year=LAST_YEAR
        )
    )


@query
def continent_completeness(spark, folder):
    return slices.continent_completeness(
        _rows(spark, folder), tables.continents(spark, folder), tables.CONTINENTS
    )


@query
def period_completeness(spark, folder):
    return slices.period_completeness(_rows(spark, folder))


@query
def phylum_counts(spark, folder):
    return slices.phylum_counts(_last(spark, folder), tables.kingdoms(spark))


@query
def dataset_counts(spark, folder):
    return A.dataset_counts(_series(spark, folder))


@query
def media_join(spark, folder):
    raw = tables.raw_occurrences(spark, folder)
    return media_ops.join_media(raw, tables.media(spark, folder))


# --- the history table ------------------------------------------------------------------------


def _history(spark: SparkSession, folder: str) -> history.History:
    return history.build(tables.scored_series(spark, folder, dealt=True), work_folder(spark, "history"))


@query
def history_runs(spark, folder):
    table = _history(spark, folder)
    return table.rows.select(
        S.RECORD_ID,
        S.DATASET,
        S.LEVEL,
        F.get(history.FLAGS, F.lit(0)).alias("flags"),
        "n",
        table.year_at(F.col(history.FIRST)).alias("first_year"),
        table.year_at(F.col(history.LAST)).alias("last_year"),
    )


@query
def history_levels(spark, folder):
    table = _history(spark, folder)
    year = table.year_at(F.col(S.SNAPSHOT_IDX)).alias(S.SNAPSHOT_YEAR)
    return table.level_totals(S.DATASET).select(year, S.DATASET, S.LEVEL, "n")


@query
def history_transitions(spark, folder):
    return A.level_transitions(_history(spark, folder))


@query
def history_decline_severity(spark, folder):
    return A.decline_severity(_history(spark, folder))


@query
def history_level_drop(spark, folder):
    return A.top_level_drop(_history(spark, folder), FROM_YEAR, TO_YEAR)


@query
def history_base_cohort(spark, folder):
    return A.base_cohort_levels(_history(spark, folder))


@query
def history_intake_cohorts(spark, folder):
    return A.intake_cohort_levels(_history(spark, folder), last_cohort_year=LAST_YEAR - 1)


@query
def history_new_levels(spark, folder):
    return A.new_record_levels(_history(spark, folder))


@query
def history_new_elements(spark, folder):
    return A.new_record_elements(_history(spark, folder))


# --- presence masks ---------------------------------------------------------------------------


def _masked(spark: SparkSession, folder: str) -> DataFrame:
    """The masks of all snapshots for all mapping sets, as a written table."""
    raw, path = tables.raw_series(spark, folder), work_folder(spark, "masks")
    masks.presence_masks(raw, list(tables.mapping_sets().values()), [S.SNAPSHOT_YEAR]).write.parquet(path)
    return spark.read.parquet(path)


@query
def presence_masks(spark, folder):
    masked = _masked(spark, folder)
    bits = {column: k for k, (column, _) in reversed([*enumerate(masks.known_properties(masked))])}
    named = [F.getbit(F.col(f"{masks.MASKS}{bits[c] // masks.BITS}"), F.lit(bits[c] % masks.BITS)) for c in MASKED]
    return masked.select(
        F.expr(f"try_cast({S.RECORD_ID} AS bigint)").alias(S.RECORD_ID),
        S.SNAPSHOT_YEAR,
        *[b.cast("int").alias(f"has_{c}") for c, b in zip(MASKED, named, strict=True)],
    )


@query
def score_mapping_sets(spark, folder):
    keep = [S.RECORD_ID, S.SNAPSHOT_YEAR]
    scored = masks.levels_of_all(_masked(spark, folder), tables.mapping_sets(), keep)
    return scored.withColumn(S.RECORD_ID, F.expr(f"try_cast({S.RECORD_ID} AS bigint)"))


@query
def score_masked(spark, folder):
    mapping = tables.mapping_sets()["moved"]
    return masks.score_masked(_masked(spark, folder), mapping, [S.SNAPSHOT_YEAR])


# --- repair of broken lines -------------------------------------------------------------------


@query
def repair_lines(spark, folder):
    return repair.repair_lines(spark, _write_dump(spark, folder, broken=True)).rows


@query
def repair_rejects(spark, folder):
    return repair.repair_lines(spark, _write_dump(spark, folder, broken=True)).rejects


@query
def repair_audit(spark, folder):
    return repair.repair_lines(spark, _write_dump(spark, folder, broken=True)).audit


# --- records under another id -----------------------------------------------------------------


@query
def changed_ids(spark, folder):
    previous = tables.raw_series(spark, folder, [FROM_YEAR], with_media=False)
    current = tables.raw_series(spark, folder, [TO_YEAR], with_media=False, record_id=tables.CHANGED_ID_SQL)
    number = F.col(S.RECORD_ID).cast("bigint")
    return renames.changed_ids(*(df.withColumn(S.RECORD_ID, number) for df in (previous, current)))


# --- the cube ---------------------------------------------------------------------------------


def _cube(spark: SparkSession, folder: str) -> cube.Cube:
    path = work_folder(spark, "cube")
    cube.write_cube(cube.cube_of(_rows(spark, folder)), path)
    return cube.read_cube(spark, path)


@query
def cube_kingdoms(spark, folder):
    return _cube(spark, folder).kingdom_completeness(tables.kingdoms(spark))


@query
def cube_continents(spark, folder):
    found = _cube(spark, folder)
    return found.continent_completeness(tables.continents(spark, folder), targets=tables.CONTINENTS)


@query
def cube_periods(spark, folder):
    return _cube(spark, folder).period_completeness()


@query
def cube_sizes(spark, folder):
    return _cube(spark, folder).levels_by_dataset_size(SIZE_BOUNDS)


# --- paths ------------------------------------------------------------------------------------


@query
def level_paths(spark, folder):
    found = paths.level_paths(_history(spark, folder))
    return found.select(paths.path_text(F.col(paths.PATH)).alias(paths.PATH), paths.RECORDS)


@query
def path_tree(spark, folder):
    return paths.path_tree(paths.level_paths(_history(spark, folder)))


@query
def path_transitions(spark, folder):
    table = _history(spark, folder)
    found = paths.path_transitions(paths.level_paths(table))
    interval = labels.interval_label(*X.interval_columns(table)).alias("interval")
    return found.select(interval, OLD, NEW, F.col("n").alias("n_records"))


# --- sketches ---------------------------------------------------------------------------------


def _sketches(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "sketches")
    sketches.id_sketches(_rows(spark, folder)).write.parquet(path)
    return spark.read.parquet(path)


@query
def sketch_changes(spark, folder):
    return sketches.changes(_sketches(spark, folder), tables.YEARS)


@query
def sketch_changes_of_snapshots(spark, folder):
    whole = sketches.rolled_up(_sketches(spark, folder))
    return sketches.changes(whole, tables.YEARS, by=()).drop("new_low", "new_high")


# --- changes of a stream ----------------------------------------------------------------------


@query
def stream_changes(spark, folder):
    records = _incoming(spark, folder, 3, 1)
    scored = incremental.score_stream(records, extra=[S.SNAPSHOT_YEAR])
    target = work_folder(spark, "changes")
    changes.run_changes(scored, tables.YEARS, target, work_folder(spark, "progress"))
    year = lambda step: F.get(F.array(*map(F.lit, tables.YEARS)), F.col(S.SNAPSHOT_IDX) + step)
    interval = labels.interval_label(year(0), year(1)).alias("interval")
    return changes.read_totals(spark, target).select(interval, OLD, NEW, F.col("n").alias("n_records"))
