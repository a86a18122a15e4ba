"""Names and types of the scored snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the scored table.
RECORD_ID = "gbifID"
DATASET = "datasetKey"
LEVEL = "MIDS_level"
YEAR = "year"
COUNTRY = "countryCode"
PHYLUM = "phylum"
ELEMENT_PREFIX = "mids:"
LEVEL_PREFIX = "mids:MIDS"

# Completeness levels, lowest first.
LEVELS = (-1, 0, 1, 2, 3)

# Columns that the series functions add.
SNAPSHOT_YEAR = "snapshot_year"
SNAPSHOT_IDX = "snapshot_idx"


def flag_columns(df: DataFrame) -> list[str]:
    """Element flags of a scored table: its boolean columns, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def quoted(name: str) -> str:
    """Back-ticked column name; element names contain colons."""
    return "`" + name.replace("`", "``") + "`"


def scored_schema(flags: list[str]) -> T.StructType:
    """Schema of a scored snapshot with the given element flags."""
    return T.StructType(
        [
            T.StructField(RECORD_ID, T.LongType()),
            T.StructField(DATASET, T.StringType()),
            T.StructField(LEVEL, T.ByteType()),
            *[T.StructField(f, T.BooleanType()) for f in flags],
            T.StructField(YEAR, T.ShortType()),
            T.StructField(COUNTRY, T.StringType()),
            T.StructField(PHYLUM, T.StringType()),
        ]
    )
