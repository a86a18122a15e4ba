"""A cube of packed flag counts: one scan of the records answers the analyses by kingdom, continent, period and size.

The records are counted once per snapshot and phylum, country, collection period and data set, by level and packed flags. The four groupings are the
grouping sets of one aggregate, combined before anything is shuffled. There are few combinations of flags, so
that the cube is small beside the records; kingdoms, continents and size classes are looked up for its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import bins, presence
from snaplevel.operators import slices
from snaplevel.operators.summary import TOTAL

PERIOD, FLAGS, N = "year_group", "flags", "n"
DIMENSIONS = (S.PHYLUM, S.COUNTRY, PERIOD, S.DATASET)
DIMENSION, VALUE = "dimension", "value"


@dataclass(frozen=True)
class Cube:
    """Rows (dimension, snapshot_year, value, level, flags, n); every dimension counts all records."""

    rows: DataFrame

    @property
    def flags(self) -> list[str]:
        return list(self.rows.schema[FLAGS].metadata["names"])

    def along(self, dimension: str) -> DataFrame:
        """The rows of one dimension, its values under its own name."""
        if dimension not in DIMENSIONS:
            raise ValueError(f"{dimension} is not a dimension of the cube: {', '.join(DIMENSIONS)}")
        rows = self.rows.where(F.col(DIMENSION) == dimension).withColumnRenamed(VALUE, dimension)
        return rows.drop(DIMENSION)

    def counts(self, dimension: str) -> DataFrame:
        """Rows and true count of every flag, per snapshot and value."""
        return self.roll_up(self.along(dimension), [S.SNAPSHOT_YEAR, dimension])

    def roll_up(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """Wide counts of cube rows by any of their columns, or columns joined to them."""
        true = [F.sum(presence.packed_flag(F.col(FLAGS), i) * F.col(N)).alias(f) for i, f in enumerate(self.flags)]
        return rows.groupBy(*by).agg(F.sum(N).alias(TOTAL), *true)

    def levels(self, dimension: str) -> DataFrame:
        """``n`` rows per snapshot, value and level."""
        return self.along(dimension).groupBy(S.SNAPSHOT_YEAR, dimension, S.LEVEL).agg(F.sum(N).alias(N))

    def kingdom_completeness(self, kingdoms: DataFrame, **options) -> DataFrame:
        return slices.kingdom_completeness_of(self.counts(S.PHYLUM), self.flags, kingdoms, **options)

    def continent_completeness(self, continents: DataFrame, **options) -> DataFrame:
        return slices.continent_completeness_of(self.counts(S.COUNTRY), self.flags, continents, **options)

    def period_completeness(self) -> DataFrame:
        return slices.completeness(self.counts(PERIOD), PERIOD, self.flags)

    def levels_by_dataset_size(self, bounds: tuple[int, int, int] = bins.SIZE_BOUNDS) -> DataFrame:
        return slices.levels_by_dataset_size_of(self.levels(S.DATASET), bounds)


def cube_of(df: DataFrame) -> Cube:
    """The cube of scored rows with ``snapshot_year``."""
    flags = S.flag_columns(df)
    names = {"names": flags}
    rows = df.select(
        S.SNAPSHOT_YEAR, S.PHYLUM, S.COUNTRY, bins.year_group(F.col(S.YEAR)).alias(PERIOD), S.DATASET,
        S.LEVEL, presence.pack_flags(flags).alias(FLAGS),
    )
    measures = [S.SNAPSHOT_YEAR, S.LEVEL, FLAGS]
    sets = [[F.col(c) for c in (*measures, d)] for d in DIMENSIONS]
    counts = rows.groupingSets(sets, *map(F.col, (*measures, *DIMENSIONS))).agg(
        F.count(F.lit(1)).alias(N), *[F.grouping(d).alias(f"_without_{d}") for d in DIMENSIONS]
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in DIMENSIONS:
        here = F.col(f"_without_{d}") == 0
        dimension, value = F.when(here, d).otherwise(dimension), F.when(here, F.col(d)).otherwise(value)
    return Cube(
        counts.select(
            dimension.alias(DIMENSION), S.SNAPSHOT_YEAR, value.alias(VALUE), S.LEVEL,
            F.col(FLAGS).alias(FLAGS, metadata=names), N,
        )
    )


def write_cube(cube: Cube, path: str, mode: str = "error") -> None:
    """The cube as a table with a folder per dimension."""
    cube.rows.write.mode(mode).option("compression", "zstd").partitionBy(DIMENSION).parquet(path)


def read_cube(spark: SparkSession, path: str) -> Cube:
    return Cube(spark.read.parquet(path))
