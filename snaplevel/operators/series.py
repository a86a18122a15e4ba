"""A series of scored snapshots as one DataFrame, and what happens to records along it.

The record functions share one shape. Records are first counted per (record id, snapshot,
attributes): a partial aggregate collapses repeated ids before anything moves, so an id that holds a
third of all rows costs a few rows. One more shuffle on the record id and one sort then serve every
interval and every cohort at once through window frames over the snapshot index. There is no
self-join, so repeated ids multiply as counts and never as row pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import presence

N = "n"
OLD, NEW = "MIDS_level_old", "MIDS_level_new"


@dataclass(frozen=True)
class SnapshotSeries:
    """Scored rows of several snapshots, with ``snapshot_year``, and the years in order.

    ``ids_unique`` states that no id repeats much within a snapshot. Record functions then shuffle
    once, by id, instead of twice, by id and attributes first. The rows are the same either way; a
    heavy id would meet in one task, so it is off unless stated.
    """

    rows: DataFrame
    years: tuple[int, ...]
    ids_unique: bool = False

    @classmethod
    def of(cls, rows: DataFrame, years: Sequence[int] | None = None) -> "SnapshotSeries":
        """Years that are not given are read from the data: one short list, one value per snapshot.

        With a table partitioned by ``snapshot_year`` that reads no column data.
        """
        if years is None:
            found = rows.select(S.SNAPSHOT_YEAR).distinct().collect()
            years = [r[0] for r in found if r[0] is not None]
        return cls(rows, tuple(sorted(set(years))))

    def index_of(self, year: Column) -> Column:
        """0-based position of a snapshot year; NULL for a year outside the series."""
        position = F.array_position(F.array(*[F.lit(y) for y in self.years]), year.cast("int"))
        return (F.nullif(position, F.lit(0).cast("bigint")) - 1).cast("int")

    def year_at(self, index: Column) -> Column:
        return F.get(F.array(*[F.lit(y) for y in self.years]), index)

    def indexed(self) -> DataFrame:
        """Rows of the series' years with ``snapshot_idx``; consecutive indexes are intervals."""
        known = F.col(S.SNAPSHOT_YEAR).isin(list(self.years))
        return self.rows.where(known).withColumn(
            S.SNAPSHOT_IDX, self.index_of(F.col(S.SNAPSHOT_YEAR))
        )

    def select(self, year: int) -> DataFrame:
        """One snapshot; prunes partitions when the table is partitioned by year."""
        return self.rows.where(F.col(S.SNAPSHOT_YEAR) == year)

    def only(self, *years: int) -> "SnapshotSeries":
        """A shorter series; its intervals are between the years that remain."""
        return replace(self, years=tuple(sorted(set(years) & set(self.years))))

    # What the analyses ask of a series; a history table answers the same from its runs.

    @property
    def flags(self) -> list[str]:
        return S.flag_columns(self.rows)

    def packed_flags(self) -> Column:
        return presence.pack_flags(self.flags).alias("flags")

    def transition_totals(self, *attributes: str) -> DataFrame:
        """Records found in two consecutive snapshots, by attributes of the earlier one and both levels."""
        pairs = matched_levels(self, *attributes)
        return pairs.groupBy(S.SNAPSHOT_IDX, *attributes, OLD, NEW).agg(F.sum(N).alias(N))

    def new_totals(self, *attributes: str | Column, empty_ids_match: bool) -> DataFrame:
        """Rows of new records per snapshot and attributes."""
        new = new_observations(self, *attributes, empty_ids_match=empty_ids_match)
        keys = [c for c in new.columns if c not in (S.RECORD_ID, N)]
        return new.groupBy(*keys).agg(F.sum(N).alias(N))

    def base_cohort_totals(self) -> DataFrame:
        return base_cohort(self)

    def intake_cohort_totals(self) -> DataFrame:
        return intake_cohorts(self)


def _along_record():
    return Window.partitionBy(S.RECORD_ID).orderBy(S.SNAPSHOT_IDX)


def observations(series: SnapshotSeries, *attributes: str | Column) -> DataFrame:
    """``n`` rows per record id, snapshot and attributes. Empty ids form one group of their own."""
    rows = series.indexed().select(S.RECORD_ID, S.SNAPSHOT_IDX, *attributes)
    if series.ids_unique:
        rows = rows.repartition(S.RECORD_ID)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(N))


def is_new(empty_ids_match: bool) -> Column:
    """Is the record absent from the snapshot just before? NULL in the first snapshot.

    ``empty_ids_match`` tells whether a row without id counts as seen before when the previous
    snapshot has such rows too (data-frame joins) or never does (SQL joins).
    """
    absent = F.count(F.lit(1)).over(_along_record().rangeBetween(-1, -1)) == 0
    if not empty_ids_match:
        absent = absent | F.col(S.RECORD_ID).isNull()
    return F.when(F.col(S.SNAPSHOT_IDX) > 0, absent)


def new_observations(
    series: SnapshotSeries, *attributes: str | Column, empty_ids_match: bool
) -> DataFrame:
    """Observations of records that the snapshot just before does not have.

    A record that vanishes and returns is new again. The first snapshot has no predecessor and
    yields nothing.
    """
    marked = observations(series, *attributes).withColumn("_new", is_new(empty_ids_match))
    return marked.where("_new").drop("_new")


def new_records(current: DataFrame, previous: DataFrame, empty_ids_match: bool = False) -> DataFrame:
    """Whole rows of ``current`` whose id ``previous`` lacks.

    The ids are made distinct first, so the right side has no heavy key. The join is on a null-safe
    key either way: it gives the right side a shuffle of its own, and only then can AQE split a
    heavy id of the left side over several tasks.
    """
    ids = previous.select(F.col(S.RECORD_ID).alias("_id")).distinct()
    if not empty_ids_match:
        ids = ids.where(F.col("_id").isNotNull())
    return current.join(ids, current[S.RECORD_ID].eqNullSafe(F.col("_id")), "left_anti")


def new_rows_of_series(series: SnapshotSeries, empty_ids_match: bool = False) -> DataFrame:
    """:func:`new_records` for every interval in one join on (id, index)."""
    rows = series.indexed()
    ids = rows.select(
        F.col(S.RECORD_ID).alias("_id"), (F.col(S.SNAPSHOT_IDX) + 1).alias("_idx")
    ).distinct()
    if not empty_ids_match:
        ids = ids.where(F.col("_id").isNotNull())
    condition = rows[S.RECORD_ID].eqNullSafe(F.col("_id")) & (rows[S.SNAPSHOT_IDX] == F.col("_idx"))
    return rows.where(F.col(S.SNAPSHOT_IDX) > 0).join(ids, condition, "left_anti")


def matched_levels(series: SnapshotSeries, *attributes: str) -> DataFrame:
    """Records found in two consecutive snapshots, with the level in both.

    ``attributes`` are taken from the earlier snapshot. ``snapshot_idx`` is that of the earlier
    snapshot. ``n`` is the number of row pairs that an inner join on the id would give: repeated ids
    multiply, but as counts, at most one row per level here. A level that no mapping can give stops
    the query instead of being lost.
    """
    obs = observations(series, S.LEVEL, *[a for a in attributes if a != S.LEVEL])
    return matched_observations(obs, *attributes)


def matched_observations(obs: DataFrame, *attributes: str) -> DataFrame:
    """The same from observations, ``n`` rows per record id, ``snapshot_idx``, level and attributes."""
    next_snapshot = _along_record().rangeBetween(1, 1)
    following = [
        F.struct(
            F.lit(level).cast("tinyint").alias(NEW),
            F.sum(F.when(F.col(S.LEVEL) == level, F.col(N))).over(next_snapshot).alias("m"),
        )
        for level in S.LEVELS
    ]
    odd = F.concat(F.lit("no completeness level: "), F.col(S.LEVEL).cast("string"))
    known = F.col(S.LEVEL).isNull() | F.col(S.LEVEL).isin(list(S.LEVELS))
    obs = obs.withColumn(S.LEVEL, F.when(known, F.col(S.LEVEL)).otherwise(F.raise_error(odd)))
    return (
        obs.withColumn("_next", F.array(*following))
        .withColumn("_pair", F.explode(F.filter("_next", lambda s: s["m"].isNotNull())))
        .select(
            S.RECORD_ID,
            S.SNAPSHOT_IDX,
            *attributes,
            F.col(S.LEVEL).alias(OLD),
            F.col(f"_pair.{NEW}").alias(NEW),
            (F.col(N) * F.col("_pair.m")).alias(N),
        )
    )


def interval_columns(series: SnapshotSeries) -> tuple[Column, Column]:
    """From and to year of the interval that starts at ``snapshot_idx``."""
    return series.year_at(F.col(S.SNAPSHOT_IDX)), series.year_at(F.col(S.SNAPSHOT_IDX) + 1)


def base_cohort(series: SnapshotSeries) -> DataFrame:
    """Level counts, per snapshot, of the records of the first snapshot."""
    whole = _along_record().rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.sum(F.when(F.col(S.SNAPSHOT_IDX) == 0, F.col(N))).over(whole)
    return (
        observations(series, S.LEVEL)
        .withColumn("_base", base)
        .where(F.col("_base").isNotNull())
        .groupBy(S.SNAPSHOT_IDX, S.LEVEL)
        .agg(F.sum(F.col(N) * F.col("_base")).alias(N))
    )


def intake_cohorts(series: SnapshotSeries) -> DataFrame:
    """Level counts of every intake cohort in its own and every later snapshot.

    A record joins a cohort each time it is new. A record's intake list holds at most one entry per
    snapshot, so it stays short whatever the data.
    """
    along = _along_record()
    so_far = along.rangeBetween(Window.unboundedPreceding, 0)
    here = F.sum(N).over(along.rangeBetween(0, 0))
    entry = F.struct(F.col(S.SNAPSHOT_IDX).alias("cohort_idx"), F.col("_here").alias("m"))
    return (
        observations(series, S.LEVEL)
        .withColumns({"_here": here, "_new": is_new(empty_ids_match=True)})
        .withColumn("_intakes", F.collect_set(F.when(F.col("_new"), entry)).over(so_far))
        .withColumn("_intake", F.explode("_intakes"))
        .groupBy(F.col("_intake.cohort_idx").alias("cohort_idx"), S.SNAPSHOT_IDX, S.LEVEL)
        .agg(F.sum(F.col(N) * F.col("_intake.m")).alias(N))
    )


def repeated_ids(series: SnapshotSeries) -> DataFrame:
    """Per snapshot: rows, distinct ids and surplus rows; a surplus means that joins multiply."""
    return (
        observations(replace(series, ids_unique=False))
        .groupBy(S.SNAPSHOT_IDX)
        .agg(F.sum(N).alias("total_rows"), F.count(F.lit(1)).alias("distinct_ids"))
        .select(
            series.year_at(F.col(S.SNAPSHOT_IDX)).alias(S.SNAPSHOT_YEAR),
            "total_rows",
            "distinct_ids",
            (F.col("total_rows") - F.col("distinct_ids")).alias("surplus_rows"),
        )
    )
