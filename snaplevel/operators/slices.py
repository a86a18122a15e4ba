"""Element completeness by kingdom, continent, collection period and data set size.

Rows are grouped by the raw key first (phylum, country, year), and the dimension is joined to the few
grouped rows. The join is then small whatever the size of the snapshots, and a dominant phylum or
country costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import bins, labels
from snaplevel.functions.shares import fraction, group_total, percent
from snaplevel.operators.summary import (
    FALSE, NAME, PCT, TOTAL, TRUE, count_by_key, element_counts, stack_elements_levels,
    unpivot_elements,
)

# The kingdoms and continents that are reported.
TARGET_KINGDOMS = ("Animalia", "Plantae", "Fungi")
TARGET_CONTINENTS = ("Africa", "Asia", "Europe", "North America", "Oceania", "South America")


def completeness(grouped: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """Sum wide counts per group and snapshot, then one row per element with its percentage."""
    summed = grouped.groupBy(group, S.SNAPSHOT_YEAR).agg(
        F.sum(TOTAL).alias(TOTAL), *[F.sum(F.col(S.quoted(f))).alias(f) for f in flags]
    )
    long = unpivot_elements(summed, [group, S.SNAPSHOT_YEAR, TOTAL], flags)
    return long.select(
        group,
        S.SNAPSHOT_YEAR,
        labels.strip_level_prefix(F.col(NAME)).alias(NAME),
        TRUE,
        TOTAL,
        percent(F.col(TRUE), F.col(TOTAL)).alias(PCT),
    )


def _lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key, the smallest, so that a repeated key of a lookup multiplies no rows."""
    return table.groupBy(key).agg(F.min(value).alias(value))


def kingdom_completeness(
    df: DataFrame,
    kingdoms: DataFrame,
    targets: Sequence[str] = TARGET_KINGDOMS,
    lookup_year: int | None = None,
) -> DataFrame:
    """Completeness per target kingdom and snapshot; ``kingdoms`` has ``phylum, kingdom``.

    A target kingdom without records keeps its rows, with total 0 and percentage NaN. With
    ``lookup_year`` only phyla that occur in that snapshot have a kingdom.
    """
    counts = element_counts(df, [S.SNAPSHOT_YEAR, S.PHYLUM])
    return kingdom_completeness_of(counts, S.flag_columns(df), kingdoms, targets, lookup_year)


def kingdom_completeness_of(
    counts: DataFrame,
    flags: list[str],
    kingdoms: DataFrame,
    targets: Sequence[str] = TARGET_KINGDOMS,
    lookup_year: int | None = None,
) -> DataFrame:
    """The same from counts per snapshot and phylum."""
    lookup = _lookup(kingdoms, S.PHYLUM, "kingdom").where(F.col("kingdom").isin(list(targets)))
    known = counts.join(lookup.withColumnRenamed("kingdom", "_kingdom"), S.PHYLUM, "left")
    if lookup_year is not None:
        in_lookup = F.count_if(F.col(S.SNAPSHOT_YEAR) == lookup_year).over(
            Window.partitionBy(S.PHYLUM)
        )
        known = known.withColumn("_kingdom", F.when(in_lookup > 0, F.col("_kingdom")))
    # Every grouped row goes to every target, with zeros where it does not belong: the few rows keep
    # empty kingdoms without a second scan.
    targeted = known.withColumn("kingdom", F.explode(F.array(*[F.lit(k) for k in targets])))
    belongs = F.col("_kingdom").eqNullSafe(F.col("kingdom"))

    def own(name: str) -> Column:
        return F.when(belongs, F.col(S.quoted(name))).otherwise(0).alias(name)

    rows = targeted.select("kingdom", S.SNAPSHOT_YEAR, own(TOTAL), *[own(f) for f in flags])
    return completeness(rows, "kingdom", flags)


def with_false_count(completeness: DataFrame) -> DataFrame:
    """The one-snapshot form of the kingdom table also shows the false count."""
    return completeness.withColumn(FALSE, F.col(TOTAL) - F.col(TRUE))


def continent_completeness(
    df: DataFrame, continents: DataFrame, targets: Sequence[str] = TARGET_CONTINENTS
) -> DataFrame:
    """Completeness per continent and snapshot; ``continents`` has ``countryCode, continent``.

    Records without country are left out. A country with two continents counts in both.
    """
    with_country = df.where(F.col(S.COUNTRY).isNotNull())
    counts = element_counts(with_country, [S.SNAPSHOT_YEAR, S.COUNTRY])
    return continent_completeness_of(counts, S.flag_columns(df), continents, targets)


def continent_completeness_of(
    counts: DataFrame,
    flags: list[str],
    continents: DataFrame,
    targets: Sequence[str] = TARGET_CONTINENTS,
) -> DataFrame:
    """The same from counts per snapshot and country; those without country meet no continent."""
    lookup = continents.where(F.col("continent").isin(list(targets)))
    return completeness(counts.join(lookup, S.COUNTRY), "continent", flags)


def period_completeness(df: DataFrame) -> DataFrame:
    """Completeness per collection period and snapshot."""
    counts = element_counts(
        df.withColumn("year_group", bins.year_group(F.col(S.YEAR))),
        [S.SNAPSHOT_YEAR, "year_group"],
    )
    return completeness(counts, "year_group", S.flag_columns(df))


def of_kingdom(df: DataFrame, kingdoms: DataFrame, kingdom: str) -> DataFrame:
    """Rows whose phylum belongs to the kingdom."""
    phyla = kingdoms.where(F.col("kingdom") == kingdom).select(S.PHYLUM)
    return df.join(phyla, S.PHYLUM, "left_semi").select(*df.columns)


def summary_for_kingdom(
    df: DataFrame, kingdoms: DataFrame, kingdom: str = "Animalia", by: Sequence[str] = ()
) -> DataFrame:
    """Summary table over the rows of one kingdom."""
    return stack_elements_levels(of_kingdom(df, kingdoms, kingdom), by)


def summary_for_kingdoms(
    df: DataFrame, kingdoms: DataFrame, names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Summary tables of several kingdoms, tagged with ``kingdom``, in one scan."""
    lookup = _lookup(kingdoms, S.PHYLUM, "kingdom").where(F.col("kingdom").isin(list(names)))
    return stack_elements_levels(df.join(lookup, S.PHYLUM), ["kingdom", *by])


def phylum_counts(df: DataFrame, kingdoms: DataFrame) -> DataFrame:
    """Rows per phylum, NULL included, with the phylum's kingdom where it has one."""
    counts = count_by_key(df, S.PHYLUM)
    return counts.join(_lookup(kingdoms, S.PHYLUM, "kingdom"), S.PHYLUM, "left").select(
        S.PHYLUM, "n", "kingdom"
    )


def dataset_sizes(
    df: DataFrame, bounds: tuple[int, int, int] = bins.SIZE_BOUNDS
) -> DataFrame:
    """Rows and size class of every data set in every snapshot."""
    sizes = count_by_key(df, S.SNAPSHOT_YEAR, S.DATASET, name="n_records")
    return sizes.withColumn("size_class", bins.size_class(F.col("n_records"), bounds))


def join_size_class(
    df: DataFrame, bounds: tuple[int, int, int] = bins.SIZE_BOUNDS
) -> DataFrame:
    """Every row with the size class of its data set. Rows without data set form one data set.

    The sizes are aggregated first and have one row per data set. They are joined on a null-safe key,
    so AQE broadcasts them when it measures them small, and otherwise may split a heavy data set.
    """
    sizes = dataset_sizes(df, bounds).select(
        F.col(S.SNAPSHOT_YEAR).alias("_y"), F.col(S.DATASET).alias("_d"), "n_records", "size_class"
    )
    same = df[S.DATASET].eqNullSafe(F.col("_d")) & (df[S.SNAPSHOT_YEAR] == F.col("_y"))
    return df.join(sizes, same).drop("_y", "_d")


def levels_by_dataset_size(
    df: DataFrame, bounds: tuple[int, int, int] = bins.SIZE_BOUNDS
) -> DataFrame:
    """Level shares (0-1) within each size class of data sets, per snapshot.

    Grouped to (snapshot, data set, level) first; the data set's size is then a sum over at most one
    row per level, not over its records.
    """
    counts = count_by_key(df, S.SNAPSHOT_YEAR, S.DATASET, S.LEVEL)
    return levels_by_dataset_size_of(counts, bounds)


def levels_by_dataset_size_of(
    counts: DataFrame, bounds: tuple[int, int, int] = bins.SIZE_BOUNDS
) -> DataFrame:
    """The same from counts ``n`` per snapshot, data set and level."""
    size = group_total("n", [S.SNAPSHOT_YEAR, S.DATASET])
    classed = counts.withColumn("size_class", bins.size_class(size, bounds))
    summed = classed.groupBy(S.SNAPSHOT_YEAR, "size_class", S.LEVEL).agg(
        F.sum("n").alias("n_records")
    )
    return summed.select(
        "size_class",
        S.LEVEL,
        "n_records",
        fraction(
            F.col("n_records"), group_total("n_records", [S.SNAPSHOT_YEAR, "size_class"])
        ).alias("pct_records"),
        S.SNAPSHOT_YEAR,
    )
