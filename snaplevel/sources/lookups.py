"""Small tables: mapping sets, dimensions, the snapshot registry, earlier summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions.labels import parse_snapshot_year
from snaplevel.mappings import MappingSet
from snaplevel.sources import text

# Columns of a summary file.
SUMMARY_SCHEMA = (
    "total_rows bigint, column_name string, true_count bigint, false_count bigint, "
    "true_percentage double"
)


def read_mapping(spark: SparkSession, path: str) -> MappingSet:
    """A mapping file as rules. It is collected: one line per element and column; blank lines are skipped."""
    short = text.capture_rejects(spark, path).where("trim(line) != ''").first()
    if short is not None:
        raise ValueError(f"{path}: too few fields in mapping line {short['line']!r}")
    rows = text.read_delimited(spark, path)
    return MappingSet.from_rows(r.asDict() for r in rows.collect())


def read_mapping_header(spark: SparkSession, folder: str, mapping_id: str) -> dict[str, str]:
    """The top-level ``key: value`` lines of a mapping set's header file, empty where there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{mapping_id}.sssom.yml")
    found = files.load(folder).select(F.decode("content", "UTF-8").alias("text")).first()
    lines = found["text"].splitlines() if found else []
    pairs = (line.partition(":") for line in lines if line[:1].strip() and not line.startswith("#"))
    return {key.strip(): value.strip() for key, colon, value in pairs if colon and value.strip()}


def read_mapping_by_id(
    spark: SparkSession, folder: str, mapping_id: str, version: str | None = None
) -> MappingSet:
    """The mapping file of a set id, as a configuration names it.

    A header file that names another set, or another version than the one asked for, is an error.
    """
    header = read_mapping_header(spark, folder, mapping_id)
    asked = {"mapping_set_id": mapping_id, "mapping_set_version": version}
    for key, value in asked.items():
        if value is not None and header.get(key, value) != value:
            raise ValueError(f"{key} of {mapping_id} is {header[key]!r}, not {value!r}")
    if version is not None and "mapping_set_version" not in header:
        raise ValueError(f"{mapping_id} states no version")
    return read_mapping(spark, f"{folder.rstrip('/')}/{mapping_id}.sssom.tsv")


def read_lookup_csv(
    spark: SparkSession, path: str, columns: dict[str, str], null_text: str = "NA"
) -> DataFrame:
    """Two or more columns of a CSV with header, renamed; ``columns`` is new name to old name.

    ``null_text`` reads as NULL. That is the usual default of CSV readers, and it makes a country
    whose code is the text ``NA`` unmatchable; pass an empty text to keep it.
    """
    rows = spark.read.csv(path, header=True, escape='"', nullValue=null_text)
    return rows.select(*[F.col(S.quoted(old)).alias(new) for new, old in columns.items()])


def read_continents(spark: SparkSession, path: str, assume_unique: bool = False) -> DataFrame:
    """Country code to continent. ``assume_unique`` keeps one continent per country, the first in
    sort order; otherwise a country with two continents counts in both."""
    rows = read_lookup_csv(
        spark,
        path,
        {S.COUNTRY: "Two_Letter_Country_Code", "continent": "Continent_Name"},
    )
    return unique_continents(rows) if assume_unique else rows


def unique_continents(continents: DataFrame) -> DataFrame:
    return continents.groupBy(S.COUNTRY).agg(F.min("continent").alias("continent"))


def read_kingdoms(spark: SparkSession, path: str) -> DataFrame:
    """Phylum to kingdom, from a tab-separated file with columns phylum, n, kingdom."""
    return text.read_delimited(spark, path).select(S.PHYLUM, "kingdom")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot registry: year of the date, key and DOI of every dump."""
    rows = text.read_delimited(spark, path)
    date, key, doi = rows.columns[:3]
    return rows.select(
        F.substring(F.col(S.quoted(date)), 1, 4).try_cast("int").alias(S.SNAPSHOT_YEAR),
        F.col(S.quoted(date)).alias("modified"),
        F.col(S.quoted(key)).alias("key"),
        F.col(S.quoted(doi)).alias("doi"),
    )


def read_summaries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Summary files of several snapshots, stacked and tagged with the year in their path."""
    rows = spark.read.schema(SUMMARY_SCHEMA).csv(
        paths, sep="\t", header=True, nullValue="", escape='"'
    )
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    year = F.coalesce(
        parse_snapshot_year(F.col("_metadata.file_path")), parse_snapshot_year(folder)
    )
    return rows.select("*", year.alias("year"))
