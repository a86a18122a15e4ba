"""Shares of totals over small, already aggregated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fraction(part: Column, whole: Column) -> Column:
    """part / whole on a 0-1 scale; an empty whole gives NaN, as floating-point division does."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(
        part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    )


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(
        F.lit(100.0) * part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    )


def percent_of_ratio(part: Column, whole: Column) -> Column:
    """(part / whole) * 100: the summary table divides first, which can differ in the last bit."""
    return fraction(part, whole) * F.lit(100.0)


def group_total(value: str, by: Sequence[str]) -> Column:
    """Sum of a count column per group, beside every row of the group.

    For grouped tables whose groups are bounded: levels, transitions, size classes. For long groups
    (data sets) see :func:`with_joined_total`.
    """
    return F.sum(value).over(Window.partitionBy(*by))


def with_joined_total(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """The same total through a join, for groups too long for one window task.

    The totals have one row per group of ``by``; they are small when the groups are snapshots or
    intervals, and then AQE turns the join into a broadcast one after it has seen their size.
    """
    totals = df.groupBy(*by).agg(F.sum(value).alias(name))
    return df.join(totals, list(by))
