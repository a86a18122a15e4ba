"""Counts of levels and element flags, per snapshot or per any other grouping.

Everything here is one grouped aggregate over the rows, combined map-side, followed by reshaping of
the small result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import labels
from snaplevel.functions.shares import group_total, percent, percent_of_ratio

TOTAL, TRUE, FALSE, PCT, NAME = (
    "total_rows", "true_count", "false_count", "true_percentage", "column_name"
)


def count_by_key(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """Rows per group; NULL is a group of its own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def level_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per level and their percentage within ``by``."""
    counts = count_by_key(df, *by, S.LEVEL)
    return counts.withColumn("percent", percent(F.col("n"), group_total("n", by)))


def element_counts(df: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """Rows and true count of every flag, all in one pass, one wide row per group."""
    flags = S.flag_columns(df)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(TOTAL), *[F.count_if(F.col(S.quoted(f))).alias(f) for f in flags]
    )


def unpivot_elements(
    wide: DataFrame, ids: Sequence[str], flags: Sequence[str], name: str = NAME
) -> DataFrame:
    """Wide counts to one row per element."""
    return wide.unpivot(
        [F.col(S.quoted(c)) for c in ids], [F.col(S.quoted(f)) for f in flags], name, TRUE
    )


def element_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total rows and true count per group and element, elements named without prefix."""
    flags = S.flag_columns(df)
    long = unpivot_elements(element_counts(df, by), [*by, TOTAL], flags)
    return long.withColumn(NAME, labels.strip_level_prefix(F.col(NAME)))


def stack_elements_levels(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The summary table: a row per element and a row per level, in one scan.

    The rows are grouped by level first. Each of those few rows then contributes its counts to all
    elements and becomes one level row itself; level rows have no false count.
    """
    flags = S.flag_columns(df)
    counts = element_counts(df, [*by, S.LEVEL])

    def entry(name: Column, true_count: Column, is_level: bool) -> Column:
        return F.struct(
            name.alias(NAME), true_count.alias(TRUE), F.lit(is_level).alias("is_level")
        )

    entries = [
        entry(labels.strip_level_prefix(F.lit(f)), F.col(S.quoted(f)), False) for f in flags
    ]
    entries.append(entry(F.col(S.LEVEL).cast("string"), F.col(TOTAL), True))
    long = counts.select(*by, TOTAL, F.explode(F.array(*entries)).alias("e"))
    summed = long.groupBy(*by, f"e.{NAME}", "e.is_level").agg(
        F.sum(TOTAL).alias("_rows"), F.sum(f"e.{TRUE}").alias(TRUE)
    )
    # A level row has only its own rows in _rows; the largest value of the group is the total.
    total = F.sum(F.when(F.col("is_level"), F.col(TRUE))).over(Window.partitionBy(*by))
    return summed.select(
        *by,
        total.alias(TOTAL),
        NAME,
        TRUE,
        F.when(~F.col("is_level"), total - F.col(TRUE)).alias(FALSE),
        F.when(F.col("is_level"), percent(F.col(TRUE), total))
        .otherwise(percent_of_ratio(F.col(TRUE), total))
        .alias(PCT),
    )


def true_false_long(elements: DataFrame) -> DataFrame:
    """Element rows twice: ``achieved`` '1' with the true count, '0' with the false count."""
    both = F.array(
        F.struct(F.lit("1").alias("achieved"), F.col(TRUE).alias("count")),
        F.struct(F.lit("0").alias("achieved"), (F.col(TOTAL) - F.col(TRUE)).alias("count")),
    )
    return elements.withColumn("_e", F.explode(both)).select(
        *[c for c in elements.columns if c not in (TRUE, FALSE)],
        F.col("_e.achieved").alias("achieved"),
        F.col("_e.count").alias(TRUE),
    )


def elements_per_level(elements: DataFrame) -> DataFrame:
    """How many different elements each level has, from an element table."""
    label = F.col(NAME)
    return count_by_key(
        elements.select(
            labels.label_level(label).alias("level"), labels.label_element(label).alias("element")
        ).distinct(),
        "level",
    )


def snapshot_totals(df: DataFrame) -> DataFrame:
    """Rows per snapshot year."""
    return count_by_key(df, S.SNAPSHOT_YEAR, name="total_records")


def largest_per_group(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """The row with the largest value of each group; ties go to the first ``tie`` in sort order."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), F.asc(tie))
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
