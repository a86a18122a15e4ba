"""Text labels of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from snaplevel.schema import ELEMENT_PREFIX, LEVEL_PREFIX

# Texts of result tables.
UNCHANGED, CHANGED = "Unchanged", "Changed"
INCREASE, DECREASE = "Increase", "Decrease"
BELOW_ZERO = "<0"
LEVEL_LABELS = (BELOW_ZERO, "0", "1", "2", "3")


def transition_label(old: Column, new: Column) -> Column:
    return F.concat(F.lit("MIDS "), old.cast("string"), F.lit(" → MIDS "), new.cast("string"))


def change_status(old: Column, new: Column) -> Column:
    return F.when(old == new, UNCHANGED).otherwise(CHANGED)


def change_direction(old: Column, new: Column) -> Column:
    return F.when(new > old, INCREASE).otherwise(DECREASE)


def level_change(old: Column, new: Column) -> Column:
    """New minus old, as int: levels are bytes."""
    return new.cast("int") - old.cast("int")


def interval_label(from_year: Column, to_year: Column) -> Column:
    return F.concat_ws("-", from_year.cast("string"), to_year.cast("string"))


def strip_element_prefix(column: Column) -> Column:
    """``mids:MIDS1Name`` to ``MIDS1Name``."""
    return F.replace(column, F.lit(ELEMENT_PREFIX), F.lit(""))


def strip_level_prefix(column: Column) -> Column:
    """``mids:MIDS1Name`` to ``1Name``."""
    return F.replace(column, F.lit(LEVEL_PREFIX), F.lit(""))


def element_group(column: Column) -> Column:
    """The level group of an element label such as ``MIDS1Name``; NULL for anything else."""
    digit = F.regexp_extract(column, "^MIDS(-1|[0-3])", 1)
    return F.when(digit != "", F.concat(F.lit("MIDS "), digit))


def label_level(column: Column) -> Column:
    """Level character of a stripped label: ``1Name`` to ``1``."""
    return F.substring(column, 1, 1)


def label_element(column: Column) -> Column:
    """Element part of a stripped label: ``1Name`` to ``Name``."""
    return F.substr(column, F.lit(2))


def year_level_key(year: Column, level: Column) -> Column:
    """Compound ``year:level`` axis key."""
    return F.concat_ws(":", year.cast("string"), level.cast("string"))


def separate_key(key: Column) -> tuple[Column, Column]:
    """Year and level label of a compound key; level -1 is shown as ``<0``."""
    parts = F.split(key, ":")
    level = F.replace(parts.getItem(1), F.lit("-1"), F.lit(BELOW_ZERO))
    return parts.getItem(0).cast("int"), level


def round_to_tenth(value: Column) -> Column:
    """Nearest tenth. Of two equally near ones the even one, judged on the double itself."""
    low, high = F.floor(value * 10), F.ceil(value * 10)
    below, above = value - low / F.lit(10.0), high / F.lit(10.0) - value
    nearest = (
        F.when(below < above, low).when(below > above, high).when(low % 2 == 0, low).otherwise(high)
    )
    return nearest / F.lit(10.0)


def percent_label(value: Column) -> Column:
    """``73.2%``; whole numbers without a decimal: ``75%``."""
    text = F.regexp_replace(round_to_tenth(value).cast("string"), r"\.0$", "")
    return F.concat(text, F.lit("%"))


def wrap_label(column: Column, width: int = 10) -> Column:
    """Break a label every ``width`` characters; every full chunk ends in a hyphen."""
    chunks = F.regexp_replace(column, "(.{%d})" % width, "$1-\n")
    return F.regexp_replace(chunks, r"\n\z", "")


def parse_snapshot_year(path: Column) -> Column:
    """Year of a dated file name: the first ``yyyy-mm-dd`` in its last path segment, else NULL."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    year = F.regexp_extract(name, r"(\d{4})-\d{2}-\d{2}", 1)
    return year.try_cast("int")


def ordinal(column: Column, order: Sequence[object]) -> Column:
    """1-based position of a value in a fixed order, 0 when it is not listed: a sort key."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), column)
