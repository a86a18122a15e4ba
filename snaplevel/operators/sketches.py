"""Sketches of record ids per snapshot and data set: what is new, kept and gone between any two snapshots without reading rows.

A theta sketch keeps the smallest hashes of a set, at most 2^lg of them. Sets up to that size are known exactly; of larger
ones the counts are estimates. Unions, intersections and differences are made of sketches alone, in any order, so a
table of them answers for every pair of snapshots and for every roll-up of data sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplevel import schema as S

IDS, EMPTY = "ids", "n_empty"
#: Logarithm of the most hashes of a sketch: sets up to 65,536 ids are exact, the largest sketch has half a megabyte.
LG = 16
#: Standard deviations between an estimate and its bounds.
WIDE = 3.0


def id_sketches(df: DataFrame, by: Sequence[str] = (S.DATASET,), lg: int = LG) -> DataFrame:
    """Per snapshot and group: the sketch of its ids, and how many rows have none. One aggregate, combined before the shuffle."""
    return df.groupBy(S.SNAPSHOT_YEAR, *by).agg(
        F.theta_sketch_agg(S.RECORD_ID, lg).alias(IDS),
        F.count_if(F.col(S.RECORD_ID).isNull()).alias(EMPTY),
    )


def rolled_up(sketches: DataFrame, by: Sequence[str] = (), lg: int = LG) -> DataFrame:
    """The sketches of larger groups, from those of their parts."""
    return sketches.groupBy(S.SNAPSHOT_YEAR, *by).agg(F.theta_union_agg(IDS, lg).alias(IDS), F.sum(EMPTY).alias(EMPTY))


def _bounds(estimate: Column, union: Column, lg: int) -> tuple[Column, Column]:
    """Of a part of a union: exact while the union fits, else that many deviations away."""
    deviation = F.sqrt(estimate * union / float(1 << lg)) + 1
    exact = union < float(1 << lg)
    low = F.when(exact, estimate).otherwise(F.greatest(F.lit(0.0), F.floor(estimate - WIDE * deviation)))
    high = F.when(exact, estimate).otherwise(F.ceil(estimate + WIDE * deviation))
    return low.cast("bigint"), high.cast("bigint")


def changes(sketches: DataFrame, years: Sequence[int], by: Sequence[str] = (S.DATASET,), lg: int = LG) -> DataFrame:
    """For every two of the snapshots, the earlier first, and group: ids kept, new and gone, and bounds of the new ones.

    A group that only one of the two has keeps nothing; one that neither has is no row. Rows without id are in no sketch; those of
    the later snapshot are ``n_empty``. The sketches of a group meet in one row, one for each snapshot.
    """
    per_year = F.collect_list(F.struct(S.SNAPSHOT_YEAR, F.struct(IDS, EMPTY)))
    groups = sketches.groupBy(*by).agg(F.map_from_entries(per_year).alias("_years"))
    ordered = sorted(set(years))
    pairs = [F.struct(F.lit(a).alias("from_year"), F.lit(b).alias("to_year")) for k, a in enumerate(ordered) for b in ordered[k + 1 :]]
    each = groups.select(*by, "_years", F.explode(F.array(*pairs)).alias("_p")).select(*by, "_years", "_p.*")
    old, new = (F.try_element_at("_years", F.col(c)) for c in ("from_year", "to_year"))
    each = each.select("from_year", "to_year", *by, old[IDS].alias("old"), new[IDS].alias("new"), new[EMPTY].alias(EMPTY))
    each = each.where("old IS NOT NULL OR new IS NOT NULL")
    # A sketch less itself stands for a side that is missing.
    other = F.coalesce("old", "new")
    nothing = F.theta_difference(other, other)
    each = each.withColumns({c: F.coalesce(c, nothing) for c in ("old", "new")})
    count = F.theta_sketch_estimate
    came = count(F.theta_difference("new", "old"))
    low, high = _bounds(came.cast("double"), count(F.theta_union("old", "new", lg)).cast("double"), lg)
    return each.select(
        "from_year",
        "to_year",
        *by,
        count(F.theta_intersection("old", "new")).alias("kept"),
        came.alias("new"),
        count(F.theta_difference("old", "new")).alias("gone"),
        low.alias("new_low"),
        high.alias("new_high"),
        F.coalesce(EMPTY, F.lit(0)).alias(EMPTY),
    )
