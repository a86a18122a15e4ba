"""A snapshot series derived from the given star-schema tables.

``orders`` plays the records, ``lineitem`` their media, ``customer`` the data sets, ``nation`` and
``region`` country and continent. A snapshot of year Y holds the orders dated before Y, except those
of one calendar month that is withheld that year: records appear, vanish and return. Which
properties a record has follows from its keys and, for some, from Y, so properties are also gained
and lost. The column texts are plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.mappings import Alternative, Element, MappingSet, default_mapping
from snaplevel.operators.media import join_media
from snaplevel.operators.scoring import score_records
from snaplevel.operators.series import SnapshotSeries

# Columns that the queries read, given so that no file footer is opened while a plan is built.
TABLE_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_returnflag string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "pages": "page_id bigint, url string",
}

YEARS = (1996, 1998, 1999, 2000, 2001, 2002)
LAST_YEAR = YEARS[-1]

SOURCE_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "n_name"
)

# Some orders share the id of the next order and some have none, as happens in real dumps.
ORDER_ID = "CAST(o_orderkey AS string)"
RECORD_ID_SQL = (
    "CASE WHEN o_orderkey % 113 = 0 THEN NULL"
    f" WHEN o_orderkey % 71 = 0 THEN CAST(o_orderkey + 1 AS string) ELSE {ORDER_ID} END"
)

# The id under which a later snapshot has some of the orders again.
CHANGED_ID_SQL = (
    f"CASE WHEN o_orderkey % 31 < 2 THEN CAST(o_orderkey + 1000000000 AS string) ELSE {RECORD_ID_SQL} END"
)

# Record columns that do not depend on the snapshot.
RECORD_COLUMNS = {
    "gbifID": RECORD_ID_SQL,
    "basisOfRecord": "CASE o_orderstatus WHEN 'O' THEN 'PRESERVED_SPECIMEN'"
    " WHEN 'F' THEN 'FOSSIL_SPECIMEN' ELSE 'HUMAN_OBSERVATION' END",
    "datasetKey": "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'ds-0'"
    " ELSE concat('ds-', CAST(o_custkey % 40 AS string)) END",
    "countryCode": "CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 61 = 0 THEN ''"
    " ELSE n_name END",
    "phylum": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderpriority END",
    "year": "CASE WHEN o_orderkey % 13 = 0 THEN NULL"
    " WHEN o_orderkey % 17 = 0 THEN 'unknown:undigitized'"
    " WHEN o_orderkey % 97 = 0 THEN '1905.5'"
    " ELSE CAST(year(o_orderdate) - (o_orderkey % 250) + (o_orderkey % 11) * 3 AS string) END",
    "catalogNumber": "CAST(o_orderkey AS string)",
    "institutionID": "CASE WHEN o_custkey % 5 < 4"
    " THEN concat('https://inst.example/', CAST(o_custkey % 17 AS string)) END",
    "scientificName": "CASE WHEN o_orderkey % 37 = 0 THEN 'incertae sedis'"
    " ELSE 'Genus species' END",
    "taxonKey": "CASE WHEN o_orderkey % 19 < 3 THEN '0'"
    " ELSE CAST(o_orderkey % 977 + 1 AS string) END",
    "license": "'CC0'",
    "modified": "CASE WHEN (o_orderkey * 11) % 100 < 70 THEN '2020-01-01' END",
    "locality": "CASE WHEN (o_orderkey * 13) % 100 < 93 THEN 'somewhere' END",
    "decimalLatitude": "CASE WHEN (o_orderkey * 17) % 100 < 60 THEN '1.5' END",
    "decimalLongitude": "CASE WHEN (o_orderkey * 17) % 100 < 62 THEN '2.5' END",
    "coordinatePrecision": "CASE WHEN o_orderkey % 10 < 9 THEN '0.01' END",
    "coordinateUncertaintyInMeters": "CASE WHEN o_orderkey % 10 < 8 THEN '30' END",
    "geodeticDatum": "CASE WHEN o_orderkey % 10 < 7 THEN 'WGS84' END",
    "recordedBy": "CASE WHEN (o_orderkey * 19) % 100 < 75 THEN 'A. Person' END",
    "recordedByID": "CASE WHEN (o_orderkey * 19) % 100 < 60 THEN 'https://person.example/1' END",
    "identifiedByID": "CASE WHEN (o_orderkey * 3) % 100 < 80 THEN 'https://person.example/2' END",
}

# Record columns that depend on the snapshot year, written as {Y}.
YEARLY_COLUMNS = {
    "institutionCode": "CASE WHEN (o_orderkey + {Y}) % 41 = 0 THEN ''"
    " ELSE concat('INST', CAST(o_custkey % 17 AS string)) END",
    "ownerInstitutionCode": "CASE WHEN (o_orderkey + {Y}) % 43 = 0 THEN 'OWN' END",
    "preparations": "CASE WHEN (o_orderkey * 7) % 100 < 40 + 4 * ({Y} - 1996) THEN 'sheet' END",
    "recordNumber": "CASE WHEN (o_orderkey * 23) % 100 < 45 + 2 * ({Y} - 1996) THEN '123' END",
    "fieldNumber": "CASE WHEN (o_orderkey + 5 * {Y}) % 31 = 0 THEN 'F1' END",
}
# Lost in some years: institutionID together with the code (level 0), and modified (level 1).
YEARLY_COLUMNS["institutionID"] = (
    "CASE WHEN (o_orderkey + {Y}) % 41 = 0 THEN 'unknown:undigitized' ELSE institutionID END"
)
YEARLY_COLUMNS["modified"] = "CASE WHEN (o_orderkey + {Y}) % 47 < 3 THEN '' ELSE modified END"

MEDIA_COLUMNS = {
    "gbifID": "CAST(l_orderkey AS string)",
    "identifier": "CASE WHEN l_returnflag <> 'R' THEN NULL"
    " ELSE concat('https://media.example/', CAST(l_partkey AS string)) END",
}

# Eight mapping sets, as changes of the default one: elements that go, and alternatives, levels and
# missing texts that differ. A leading "!" negates an alternative.
MAPPING_SETS: dict[str, dict] = {
    "default": {},
    "no media": {"without": ("Media", "MediaID")},
    "three levels": {"without_levels": (3,)},
    "strict location": {"rules": {"QualitativeLocation": (("locality", "countryCode"),)}},
    "either agent": {"rules": {"CollectingAgent": ("recordedBy", "!recordedByID identifiedByID")}},
    "any date": {"missing": {"year": ("",)}},
    "three elements": {"only": ("License", "Name", "DateCollected")},
    "moved": {"levels": {"Modified": 2, "ObjectType": 0, "IdentifiedByID": 1}},
}


def mapping_sets() -> dict[str, MappingSet]:
    """The mapping sets by name."""
    return {name: _changed(default_mapping(), **change) for name, change in MAPPING_SETS.items()}


def _changed(
    mapping: MappingSet,
    without: Sequence[str] = (),
    without_levels: Sequence[int] = (),
    only: Sequence[str] | None = None,
    rules: Mapping[str, Sequence[str | tuple[str, ...]]] | None = None,
    levels: Mapping[str, int] | None = None,
    missing: Mapping[str, tuple[str, ...]] | None = None,
) -> MappingSet:
    def alternative(given: str | tuple[str, ...]) -> Alternative:
        columns = given if isinstance(given, tuple) else tuple(given.lstrip("!").split())
        return Alternative(columns, isinstance(given, str) and given.startswith("!"))

    def changed(e: Element) -> Element:
        given = (rules or {}).get(e.name)
        alternatives = e.alternatives if given is None else tuple(map(alternative, given))
        return Element((levels or {}).get(e.name, e.level), e.name, alternatives)

    kept = [
        changed(e) for e in mapping.elements
        if e.name not in without and e.level not in without_levels and (only is None or e.name in only)
    ]
    kept.sort(key=lambda e: e.level)
    return MappingSet(tuple(kept), {**mapping.sentinels, **(missing or {})})


# Which snapshots an order is in: later than its date, and its month is not the one withheld.
WITHHELD = "month(o_orderdate) = {Y} - 1995"

KINGDOM_OF = (
    ("1-URGENT", "Animalia"),
    ("2-HIGH", "Animalia"),
    ("3-MEDIUM", "Plantae"),
    ("4-NOT SPECIFIED", "Fungi"),
)
CONTINENTS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")


# Kinds of text files of a dump, and rows of a file, about.
DUMP_FILES, DUMP_ROWS = 6, 20_000
# Orders whose snapshots are a file that a stream picks up, about.
SHARE_ORDERS = 100_000
# Orders whose snapshots one task sorts, about, where rows are written by snapshot.
TASK_ORDERS = 100_000


def turned(columns: list[str]) -> list[str]:
    """The columns in the order of the dump's first file: the first one moved before the last."""
    return [*columns[1:-1], columns[0], columns[-1]]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def parts_of(spark: SparkSession, folder: str, orders: int) -> int:
    """Parts of about so many orders each, one at least."""
    return -(-table(spark, folder, "orders").count() // orders) or 1


def _expressions(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def _source_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One narrow row per order, with the columns that the record columns are made of."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(*SOURCE_COLUMNS)
    )


def raw_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """One raw row per order, all text, as a dump has them."""
    return _source_rows(spark, folder).selectExpr(*_expressions(RECORD_COLUMNS))


def media(spark: SparkSession, folder: str) -> DataFrame:
    """The one-to-many media extension."""
    return table(spark, folder, "lineitem").selectExpr(*_expressions(MEDIA_COLUMNS))


def raw_series(
    spark: SparkSession,
    folder: str,
    years: Iterable[int] = YEARS,
    with_media: bool = True,
    withheld: str = WITHHELD,
    record_id: str = RECORD_ID_SQL,
    dealt: bool = False,
) -> DataFrame:
    """Raw rows of every snapshot with ``snapshot_year``.

    Media are joined to the narrow rows, once per record; only then are the rows repeated for their
    snapshots and widened. ``dealt`` narrow rows are spread evenly over tasks whose number grows with them, which
    costs a shuffle of these, so that what a task makes of them stays bounded.
    """
    records = _source_rows(spark, folder)
    if with_media:
        keyed = records.withColumn(S.RECORD_ID, F.expr(record_id))
        records = join_media(keyed, media(spark, folder)).drop(S.RECORD_ID)
    parts = parts_of(spark, folder, TASK_ORDERS) if dealt else 1
    if parts > 1:
        records = records.repartition(max(parts, spark.sparkContext.defaultParallelism))
    all_years = F.array(*[F.lit(y) for y in sorted(years)])
    rows = records.withColumn(
        S.SNAPSHOT_YEAR, F.explode(F.filter(all_years, lambda y: y > F.year("o_orderdate")))
    ).where(f"NOT ({withheld.format(Y=S.SNAPSHOT_YEAR)})")
    added = [c for c in rows.columns if c not in SOURCE_COLUMNS]
    columns = {**RECORD_COLUMNS, S.RECORD_ID: record_id}
    wide = rows.selectExpr(*SOURCE_COLUMNS, *added, *_expressions(columns))
    yearly = {c: sql.format(Y=S.SNAPSHOT_YEAR) for c, sql in YEARLY_COLUMNS.items()}
    kept = [c for c in RECORD_COLUMNS if c not in yearly]
    return wide.selectExpr(*kept, *added, *_expressions(yearly))


def scored_series(
    spark: SparkSession, folder: str, years: Iterable[int] = YEARS, dealt: bool = False
) -> SnapshotSeries:
    """The scored series that the analyses read; ``dealt`` as in :func:`raw_series`."""
    years = tuple(years)
    scored = score_records(raw_series(spark, folder, years, dealt=dealt), extra=[S.SNAPSHOT_YEAR])
    return SnapshotSeries.of(scored, years)


def kingdoms(spark: SparkSession) -> DataFrame:
    """Kingdoms of the order priorities; the fifth has none."""
    rows = ", ".join(f"('{p}', '{k}')" for p, k in KINGDOM_OF)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(phylum, kingdom)")


def continents(spark: SparkSession, folder: str) -> DataFrame:
    """Country and continent from nation and region."""
    joined = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        F.col("n_name").alias(S.COUNTRY), F.col("r_name").alias("continent")
    )
