"""The analyses over a snapshot series, those along records also over a history table.

Output columns are the contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import labels, presence
from snaplevel.functions.shares import fraction, group_total, percent, with_joined_total
from snaplevel.operators import series as X
from snaplevel.operators.history import History
from snaplevel.operators.series import NEW, OLD, SnapshotSeries
from snaplevel.operators.summary import (
    NAME, PCT, TOTAL, TRUE, count_by_key, element_counts, largest_per_group,
    stack_elements_levels, unpivot_elements,
)


# --- one snapshot, or each snapshot by itself -------------------------------------------------


def snapshot_summary(series: SnapshotSeries, year: int) -> DataFrame:
    """Summary table of one snapshot."""
    return stack_elements_levels(series.select(year))


def element_trend_counts(series: SnapshotSeries) -> DataFrame:
    """True count per element and snapshot."""
    return element_trend_fraction(series).select(S.SNAPSHOT_YEAR, "element", TRUE)


def element_trend_fraction(series: SnapshotSeries) -> DataFrame:
    """True count, total and share (0-1) per element and snapshot; totals come from the same pass."""
    rows = series.indexed()
    wide = element_counts(rows, [S.SNAPSHOT_YEAR])
    long = unpivot_elements(wide, [S.SNAPSHOT_YEAR, TOTAL], S.flag_columns(rows), "element")
    element = labels.strip_element_prefix(F.col("element"))
    return long.select(
        S.SNAPSHOT_YEAR,
        element.alias("element"),
        TRUE,
        F.col(TOTAL).alias("total_records"),
        fraction(F.col(TRUE), F.col(TOTAL)).alias("true_pct"),
        labels.element_group(element).alias("mids_group"),
    )


def levels_over_time(summaries: DataFrame) -> DataFrame:
    """Level rows of stacked summary tables (with ``year``), in axis order.

    The window without partition numbers a handful of rows: one per snapshot and level.
    """
    rows = summaries.where(F.col(NAME).rlike("^-?[0-9]+$"))
    year, level = labels.separate_key(labels.year_level_key(F.col("year"), F.col(NAME)))
    order = Window.orderBy("year", labels.ordinal(F.col("level"), labels.LEVEL_LABELS))
    return rows.select(year.alias("year"), level.alias("level"), TRUE, PCT).withColumn(
        "xpos", F.row_number().over(order)
    )


def records_over_time(levels: DataFrame) -> DataFrame:
    """Total and axis range per year, from :func:`levels_over_time`."""
    low, high = F.min("xpos"), F.max("xpos")
    return levels.groupBy("year").agg(
        F.sum(TRUE).alias("total"),
        low.alias("xmin"),
        high.alias("xmax"),
        ((low + high) / 2.0).alias("mid"),
    )


def summaries_of(series: SnapshotSeries) -> DataFrame:
    """Summary tables of all snapshots, tagged with the year."""
    return stack_elements_levels(series.indexed(), [S.SNAPSHOT_YEAR]).withColumnRenamed(
        S.SNAPSHOT_YEAR, "year"
    )


def dataset_counts(series: SnapshotSeries) -> DataFrame:
    """Rows per snapshot and data set."""
    return count_by_key(series.indexed(), S.SNAPSHOT_YEAR, S.DATASET)


def row_counts(series: SnapshotSeries) -> DataFrame:
    """Rows per snapshot."""
    return count_by_key(series.indexed(), S.SNAPSHOT_YEAR)


# --- new records ------------------------------------------------------------------------------


def new_record_levels(series: SnapshotSeries | History) -> DataFrame:
    """Level distribution of the records each snapshot adds. Rows without id are always new."""
    counts = series.new_totals(S.LEVEL, empty_ids_match=False)
    return counts.select(
        S.LEVEL,
        "n",
        percent(F.col("n"), group_total("n", [S.SNAPSHOT_IDX])).alias("percent"),
        series.year_at(F.col(S.SNAPSHOT_IDX)).alias("year"),
    )


def new_record_elements(series: SnapshotSeries | History) -> DataFrame:
    """Element completeness (0-1) of the records each snapshot adds.

    The flags travel through the shuffles as one packed number. New records are grouped by that number
    before it is unpacked: there are few combinations of flags, so the per-element sums see few rows.
    """
    flags = series.flags
    combinations = series.new_totals(series.packed_flags(), empty_ids_match=True)
    wide = combinations.groupBy(S.SNAPSHOT_IDX).agg(
        F.sum(X.N).alias("total_new"),
        *[
            F.sum(presence.packed_flag(F.col("flags"), i) * F.col(X.N)).alias(f)
            for i, f in enumerate(flags)
        ],
    )
    long = unpivot_elements(wide, [S.SNAPSHOT_IDX, "total_new"], flags, "element")
    to_year = series.year_at(F.col(S.SNAPSHOT_IDX))
    from_year = series.year_at(F.col(S.SNAPSHOT_IDX) - 1)
    return long.select(
        labels.interval_label(from_year, to_year).alias("interval"),
        to_year.alias("year"),
        labels.strip_element_prefix(F.col("element")).alias("element"),
        TRUE,
        "total_new",
        fraction(F.col(TRUE), F.col("total_new")).alias("true_pct"),
    )


# --- cohorts ----------------------------------------------------------------------------------


def _cohort_shares(series: SnapshotSeries | History, counts: DataFrame, by: list[str]) -> DataFrame:
    total = group_total(X.N, by)
    return counts.withColumns(
        {
            S.SNAPSHOT_YEAR: series.year_at(F.col(S.SNAPSHOT_IDX)),
            "total_records": total,
            "pct_records": fraction(F.col(X.N), total),
        }
    )


def base_cohort_levels(series: SnapshotSeries | History) -> DataFrame:
    """Levels, through time, of the records of the first snapshot; shares are of the survivors."""
    shares = _cohort_shares(series, series.base_cohort_totals(), [S.SNAPSHOT_IDX])
    return shares.select(S.LEVEL, "n", S.SNAPSHOT_YEAR, "total_records", "pct_records")


def intake_cohort_levels(
    series: SnapshotSeries | History, last_cohort_year: int | None = None
) -> DataFrame:
    """Levels, through time, of the records that each snapshot adds; shares are of the survivors."""
    counts = series.intake_cohort_totals()
    shares = _cohort_shares(series, counts, ["cohort_idx", S.SNAPSHOT_IDX])
    out = shares.withColumn("cohort_year", series.year_at(F.col("cohort_idx")))
    if last_cohort_year is not None:
        out = out.where(F.col("cohort_year") <= last_cohort_year)
    return out.select(
        "cohort_year", S.SNAPSHOT_YEAR, S.LEVEL, "n", "total_records", "pct_records"
    )


def cohort_entry_levels(cohorts: DataFrame) -> DataFrame:
    """Cohorts in the snapshot that first has them."""
    return cohorts.where(F.col(S.SNAPSHOT_YEAR) == F.col("cohort_year"))


# --- level transitions ------------------------------------------------------------------------


def _interval(series: SnapshotSeries | History) -> Column:
    return labels.interval_label(*X.interval_columns(series)).alias("interval")


def transition_counts(series: SnapshotSeries | History) -> DataFrame:
    """Matched records per interval and pair of levels: at most 25 rows per interval."""
    totals = series.transition_totals().withColumnRenamed(X.N, "n_records")
    return totals.withColumn("interval", _interval(series))


def change_status_by_interval(series: SnapshotSeries | History) -> DataFrame:
    """Matched records whose level changed or not; share of the interval (0-1)."""
    status = labels.change_status(F.col(OLD), F.col(NEW)).alias("status")
    counts = (
        transition_counts(series).groupBy("interval", status).agg(F.sum("n_records").alias("n"))
    )
    total = group_total("n", ["interval"])
    return counts.withColumns({"total": total, "percent": fraction(F.col("n"), total)})


def level_transitions(series: SnapshotSeries | History) -> DataFrame:
    """Every level change per interval with its share of all matched and of all changed records."""
    old, new = F.col(OLD), F.col(NEW)
    everything = transition_counts(series).withColumn(
        "total_records", group_total("n_records", ["interval"])
    )
    changed = everything.where(old != new)
    n = F.col("n_records")
    shares = changed.select(
        "interval",
        labels.transition_label(old, new).alias("transition"),
        labels.change_direction(old, new).alias("direction"),
        "n_records",
        "total_records",
        percent(n, F.col("total_records")).alias("pct_of_all_records"),
        percent(n, group_total("n_records", ["interval"])).alias("pct_of_changes"),
    )
    return shares.withColumn("label", labels.percent_label(F.col("pct_of_changes")))


def largest_transition(series: SnapshotSeries | History) -> DataFrame:
    """The most frequent level change of each interval."""
    return largest_per_group(level_transitions(series), ["interval"], "n_records", "transition")


def direction_summary(series: SnapshotSeries | History) -> DataFrame:
    """Increases and decreases per interval.

    The percentages of a direction add up to that of its summed count; taking it from the count does
    not depend on the order of addition.
    """
    counts = level_transitions(series).groupBy("direction", "interval").agg(
        F.sum("n_records").alias("n_records"), F.max("total_records").alias("_total")
    )
    n = F.col("n_records")
    return counts.select(
        "direction",
        "interval",
        "n_records",
        percent(n, F.col("_total")).alias("pct_of_all_records"),
        percent(n, group_total("n_records", ["interval"])).alias("pct_of_changes"),
    )


# --- declines by data set ---------------------------------------------------------------------


def declines(series: SnapshotSeries) -> DataFrame:
    """Matched records whose level fell: id, data set of the earlier snapshot, change, weight."""
    pairs = X.matched_levels(series, S.DATASET)
    change = labels.level_change(F.col(OLD), F.col(NEW))
    from_year, to_year = X.interval_columns(series)
    return pairs.where(change < 0).withColumns(
        {"change": change, "from_year": from_year, "to_year": to_year}
    )


def decline_totals(series: SnapshotSeries | History) -> DataFrame:
    """Declined records per interval, data set of the earlier snapshot and pair of levels."""
    from_year, to_year = X.interval_columns(series)
    change = labels.level_change(F.col(OLD), F.col(NEW))
    totals = series.transition_totals(S.DATASET).where(change < 0)
    return totals.withColumns({"change": change, "from_year": from_year, "to_year": to_year})


def declining_datasets(series: SnapshotSeries | History) -> DataFrame:
    """Data sets by number of declined records, largest first."""
    counts = decline_totals(series).groupBy(S.DATASET).agg(F.sum(X.N).alias("n_declined_specimens"))
    return counts.orderBy(F.desc("n_declined_specimens"), S.DATASET)


def declining_datasets_by_interval(series: SnapshotSeries | History) -> DataFrame:
    """The same per interval, largest first within the interval."""
    counts = decline_totals(series).groupBy("from_year", "to_year", S.DATASET).agg(
        F.sum(X.N).alias("n_declined_specimens")
    )
    return counts.orderBy("from_year", F.desc("n_declined_specimens"), S.DATASET)


def decline_severity(series: SnapshotSeries | History) -> DataFrame:
    """Declined records, mean and largest drop per data set, largest count first."""
    drop = F.abs("change")
    counts = decline_totals(series).groupBy(S.DATASET).agg(
        F.sum(X.N).alias("specimens_declined"),
        (F.sum(drop * F.col(X.N)).cast("double") / F.sum(X.N).cast("double")).alias("mean_drop"),
        F.max(drop).alias("max_drop"),
    )
    return counts.orderBy(F.desc("specimens_declined"), S.DATASET)


def top_level_drop(
    series: SnapshotSeries | History,
    from_year: int,
    to_year: int,
    old_level: int = 1,
    new_level: int = 0,
    k: int = 10,
) -> DataFrame:
    """The k data sets with most records that fell from one level to another between two snapshots.

    The percentage is of all such records, taken before the cut. The two snapshots need not be
    neighbours.
    """
    pair = series.only(from_year, to_year)
    name = f"records_{old_level}_to_{new_level}"
    fell = pair.transition_totals(S.DATASET).where(
        (F.col(OLD) == old_level) & (F.col(NEW) == new_level)
    )
    counts = fell.select(S.SNAPSHOT_IDX, S.DATASET, F.col(X.N).alias(name))
    shares = with_joined_total(counts, name, [S.SNAPSHOT_IDX], "_total")
    return (
        shares.select(
            S.DATASET,
            name,
            percent(F.col(name), F.col("_total")).alias(f"pct_of_all_{old_level}_to_{new_level}"),
        )
        .orderBy(F.desc(name), S.DATASET)
        .limit(k)
    )
