"""Fixed-width and threshold bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Data set size classes and their upper bounds (exclusive).
SIZE_CLASSES = ("Small", "Medium", "Large", "Very Large")
SIZE_BOUNDS = (10_000, 100_000, 1_000_000)

# Collection periods with first and last year; anything else is unknown.
PERIODS = (
    ("Pre-1800", None, 1799),
    ("1800-1899", 1800, 1899),
    ("1900-1949", 1900, 1949),
    ("1950-1999", 1950, 1999),
    ("2000-2024", 2000, 2024),
)
UNKNOWN_PERIOD = "Unknown"
PERIOD_ORDER = (*[p[0] for p in PERIODS], UNKNOWN_PERIOD)


def size_class(n_records: Column, bounds: tuple[int, int, int] = SIZE_BOUNDS) -> Column:
    small, medium, large = bounds
    return (
        F.when(n_records < small, SIZE_CLASSES[0])
        .when(n_records < medium, SIZE_CLASSES[1])
        .when(n_records < large, SIZE_CLASSES[2])
        .otherwise(SIZE_CLASSES[3])
    )


def year_group(year: Column) -> Column:
    """Collection period of a year; NULL and years after the last period are unknown."""
    chain = F.when(year.isNull(), UNKNOWN_PERIOD)
    for name, first, last in PERIODS:
        inside = year <= last if first is None else year.between(first, last)
        chain = chain.when(inside, name)
    return chain.otherwise(UNKNOWN_PERIOD)
