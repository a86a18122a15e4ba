"""A history table: a row per run of snapshots in which a record looks the same, kept up snapshot by snapshot.

A run is a record id with its data set, level and flags, the number ``n`` of rows that have them, and the first and last
index of neighbouring snapshots where all of that is so. A record that never changes is one row, whatever the
number of snapshots. :func:`add_snapshot` joins a new snapshot to the runs that reach the one before: equal ones grow,
the others end there or begin here. Nothing else is read, and nothing written before is touched.

The analyses take a :class:`History` like a series of snapshots. Intervals are intersections of runs, added up by first
and last index before they are spread over the snapshots between.

Layout: ``snapshot_year=Y/open=1`` has the runs up to the snapshot of Y, ``open=0`` those that ended with the one before.
The table at Y is all of ``open=0`` up to Y and ``open=1`` of Y. A folder is written by one job, so a job that failed is
run again, and an older state of the table stays readable (``up_to``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import presence
from snaplevel.operators.series import N, NEW, OLD, SnapshotSeries
from snaplevel.sources import sinks

FIRST, LAST, FLAGS, OPEN = "first_idx", "last_idx", "flags", "open"
ROWS = "_rows/scored"
STATE = (S.RECORD_ID, S.DATASET, S.LEVEL, FLAGS, N)
#: Longest list of a record's runs by level that is intersected as it is; a longer one is counted out by snapshot.
MOST_RUNS = 64


@dataclass(frozen=True)
class History:
    """Runs, with ``first_idx`` and ``last_idx``, and the years in order."""

    rows: DataFrame
    years: tuple[int, ...]

    @property
    def flags(self) -> list[str]:
        """Names of the packed flags."""
        return list(self.rows.schema[FLAGS].metadata["names"])

    def packed_flags(self) -> Column:
        return F.col(FLAGS)

    def year_at(self, index: Column) -> Column:
        return F.get(F.array(*[F.lit(y) for y in self.years]), index)

    def only(self, *years: int) -> "History":
        """A shorter history; its intervals are between the years that remain."""
        left = [k for k, y in enumerate(self.years) if y in years]
        before = lambda c: F.expr("+".join([f"int({k} < {c})" for k in left]) or "0")
        rows = self.rows.withColumns({FIRST: before(FIRST), LAST: before(f"{LAST} + 1") - 1})
        return History(rows.where(F.col(FIRST) <= F.col(LAST)), tuple(self.years[k] for k in left))

    def at(self, year: int) -> DataFrame:
        """``n`` rows per record id, data set, level and flags of one snapshot."""
        idx = self.years.index(year)
        return self.rows.where((F.col(FIRST) <= idx) & (F.col(LAST) >= idx)).select(*STATE)

    def level_totals(self, *attributes: str) -> DataFrame:
        """Rows per snapshot, attributes and level."""
        keys = [*attributes, S.LEVEL]
        return _spread(self.rows.groupBy(*keys, FIRST, LAST).agg(F.sum(N).alias(N)), FIRST, LAST, keys)

    def transition_totals(self, *attributes: str) -> DataFrame:
        """Records found in two consecutive snapshots, by attributes of the earlier one and both levels."""
        runs = [S.LEVEL, FIRST, LAST]
        left = self.rows.groupBy(S.RECORD_ID, *attributes, *runs).agg(F.sum(N).alias(N))
        right = self.rows.groupBy(F.col(S.RECORD_ID).alias("_id"), *runs).agg(F.sum(N).alias(N))
        right = right.groupBy("_id").agg(F.collect_list(F.struct(*runs, N)).alias("_runs"))
        right = right.withColumn("_runs", self._bounded(F.col("_runs")))
        # Where the earlier snapshot is in this run and the later one in that.
        low = lambda r: F.greatest(F.col(FIRST), r[FIRST] - 1)
        high = lambda r: F.least(F.col(LAST), r[LAST] - 1)
        met = F.transform(
            F.filter("_runs", lambda r: low(r) <= high(r)),
            lambda r: F.struct(r[S.LEVEL].alias(NEW), low(r).alias("low"), high(r).alias("high"), r[N].alias("m")),
        )
        pairs = left.join(right, left[S.RECORD_ID].eqNullSafe(right["_id"])).select(
            *attributes, F.col(S.LEVEL).alias(OLD), N, F.explode(met).alias("_met")
        )
        keys = [*attributes, OLD, NEW]
        pairs = pairs.select(*attributes, OLD, f"_met.{NEW}", "_met.low", "_met.high", (F.col(N) * F.col("_met.m")).alias(N))
        return _spread(pairs.groupBy(*keys, "low", "high").agg(F.sum(N).alias(N)), "low", "high", keys)

    def _bounded(self, runs: Column) -> Column:
        """A record's runs, or, if they are many, its rows per level and snapshot as runs of one snapshot."""

        def one(level: int, idx: Column) -> Column:
            here = F.filter(runs, lambda r: r[S.LEVEL].eqNullSafe(F.lit(level)) & (r[FIRST] <= idx) & (r[LAST] >= idx))
            n = F.aggregate(here, F.lit(0).cast("bigint"), lambda total, r: total + r[N])
            return F.struct(F.lit(level).cast("tinyint").alias(S.LEVEL), idx.alias(FIRST), idx.alias(LAST), n.alias(N))

        every = F.sequence(F.lit(0), F.lit(len(self.years) - 1))
        counted = [F.transform(every, partial(one, level)) for level in (*S.LEVELS, None)]
        counted = F.filter(F.flatten(F.array(*counted)), lambda r: r[N] > 0)
        return F.when(F.size(runs) > MOST_RUNS, counted).otherwise(runs)

    def _starts(self) -> DataFrame:
        """(id, index) wherever a record comes in that the snapshot just before lacks, the first snapshot aside."""
        seen = self.rows.select(S.RECORD_ID, FIRST, LAST).distinct()
        before = Window.partitionBy(S.RECORD_ID).orderBy(FIRST).rowsBetween(Window.unboundedPreceding, -1)
        seen = seen.withColumn("_until", F.max(LAST).over(before))
        gap = F.col("_until").isNull() | (F.col("_until") < F.col(FIRST) - 1)
        return seen.where(gap & (F.col(FIRST) > 0)).select(F.col(S.RECORD_ID).alias("_id"), F.col(FIRST).alias("_start"))

    def _entries(self, starts: DataFrame) -> DataFrame:
        """The runs that begin with a record's coming in."""
        same = self.rows[S.RECORD_ID].eqNullSafe(starts["_id"]) & (self.rows[FIRST] == starts["_start"])
        return self.rows.join(starts, same)

    def new_totals(self, *attributes: str | Column, empty_ids_match: bool) -> DataFrame:
        """Rows of new records per snapshot and attributes."""
        starts = self._starts()
        if not empty_ids_match:
            starts = starts.where(F.col("_id").isNotNull())
        new = self._entries(starts).select(F.col(FIRST).alias(S.SNAPSHOT_IDX), *attributes, N)
        if not empty_ids_match:
            later = F.sequence(F.greatest(F.col(FIRST), F.lit(1)), F.col(LAST))
            empty = self.rows.where(F.col(S.RECORD_ID).isNull() & (F.col(LAST) > 0))
            new = new.unionByName(empty.select(F.explode(later).alias(S.SNAPSHOT_IDX), *attributes, N))
        keys = [c for c in new.columns if c != N]
        return new.groupBy(*keys).agg(F.sum(N).alias(N))

    def base_cohort_totals(self) -> DataFrame:
        """Level counts, per snapshot, of the records of the first snapshot."""
        base = self.rows.where(F.col(FIRST) == 0).groupBy(F.col(S.RECORD_ID).alias("_id")).agg(F.sum(N).alias("_base"))
        both = self.rows.join(base, self.rows[S.RECORD_ID].eqNullSafe(base["_id"]))
        sums = both.groupBy(S.LEVEL, FIRST, LAST).agg(F.sum(F.col(N) * F.col("_base")).alias(N))
        return _spread(sums, FIRST, LAST, [S.LEVEL])

    def intake_cohort_totals(self) -> DataFrame:
        """Level counts of every intake cohort in its own and every later snapshot."""
        entries = self._entries(self._starts())
        cohorts = entries.groupBy("_id", F.col("_start").alias("cohort_idx")).agg(F.sum(N).alias("_size"))
        same = self.rows[S.RECORD_ID].eqNullSafe(cohorts["_id"]) & (self.rows[LAST] >= cohorts["cohort_idx"])
        both = self.rows.join(cohorts, same)
        keys = ["cohort_idx", S.LEVEL]
        low = F.greatest(F.col(FIRST), F.col("cohort_idx")).alias("low")
        sums = both.groupBy(*keys, low, F.col(LAST).alias("high")).agg(F.sum(F.col(N) * F.col("_size")).alias(N))
        return _spread(sums, "low", "high", keys)


def _spread(sums: DataFrame, low: str, high: str, keys: list[str]) -> DataFrame:
    """Counts per range of snapshots as counts per snapshot."""
    each = sums.select(F.explode(F.sequence(F.col(low), F.col(high))).alias(S.SNAPSHOT_IDX), *keys, N)
    return each.groupBy(S.SNAPSHOT_IDX, *keys).agg(F.sum(N).alias(N))


def packed_rows(rows: DataFrame, *others: str) -> DataFrame:
    """What a state of a scored row is made of, its flags packed, and other columns."""
    flags = S.flag_columns(rows)
    packed = presence.pack_flags(flags).alias(FLAGS, metadata={"names": flags})
    return rows.select(S.RECORD_ID, S.DATASET, S.LEVEL, packed, *others)


def snapshot_states(rows: DataFrame) -> DataFrame:
    """``n`` rows per record id, data set, level and packed flags of one scored snapshot, whose flags may be packed already."""
    packed = FLAGS in rows.columns and "names" in rows.schema[FLAGS].metadata
    states = (rows if packed else packed_rows(rows)).groupBy(*STATE[:-1])
    return states.agg(F.count(F.lit(1)).alias(N))


def merged(reaching: DataFrame, states: DataFrame, idx: int) -> DataFrame:
    """Runs that reach the snapshot before ``idx``, grown or ended, and those that begin with ``idx``.

    One full outer join on the whole state, so that no id is heavier than its different states.
    """
    old = reaching.select(*STATE, FIRST, F.lit(True).alias("_old"))
    new = states.select(*[F.col(c).alias(f"_{c}") for c in STATE], F.lit(True).alias("_new"))
    same = reduce(Column.__and__, [old[c].eqNullSafe(new[f"_{c}"]) for c in STATE])
    grown = F.col("_new").isNotNull()
    names = states.schema[FLAGS].metadata
    return old.join(new, same, "full_outer").select(
        *[F.coalesce(c, f"_{c}").alias(c, **({"metadata": names} if c == FLAGS else {})) for c in STATE],
        F.coalesce(FIRST, F.lit(idx)).alias(FIRST),
        F.when(grown, idx).otherwise(idx - 1).alias(LAST),
        grown.cast("int").alias(OPEN),
    )


def history_years(spark: SparkSession, path: str) -> tuple[int, ...]:
    """Years of a history table, in order; no column is read."""
    found = spark.read.parquet(path).select(S.SNAPSHOT_YEAR).distinct().collect()
    return tuple(sorted(r[0] for r in found))


def _reaching(spark: SparkSession, path: str, year: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{S.SNAPSHOT_YEAR}={year}").where(F.col(OPEN) == 1)


def add_snapshot(spark: SparkSession, path: str, rows: DataFrame, year: int, years: tuple[int, ...] = ()) -> tuple[int, ...]:
    """Add a scored snapshot to the table, whose ``years`` are those before; returns the years with it.

    Only the snapshot and the runs that reach the one before are read. Snapshots come in order; flags stay the same. A
    snapshot without rows is refused: it would leave no trace in the table.
    """
    if years and year <= years[-1]:
        raise ValueError(f"{year} is not after {years[-1]}, the last snapshot of the history")
    if rows.isEmpty():
        raise ValueError(f"the snapshot of {year} has no rows")
    states = snapshot_states(rows)
    if years:
        reaching = _reaching(spark, path, years[-1])
        names = reaching.schema[FLAGS].metadata["names"]
        if names != states.schema[FLAGS].metadata["names"]:
            raise ValueError(f"the history has flags {', '.join(names)}, the snapshot others")
        runs = merged(reaching, states, len(years))
    else:
        runs = states.select(*STATE, F.lit(0).alias(FIRST), F.lit(0).alias(LAST), F.lit(1).alias(OPEN))
    folder = f"{path}/{S.SNAPSHOT_YEAR}={year}"
    runs.write.mode("overwrite").option("compression", "zstd").partitionBy(OPEN).parquet(folder)
    return (*years, year)


def read_history(spark: SparkSession, path: str, years: tuple[int, ...] | None = None, up_to: int | None = None) -> History:
    """The table with its last snapshot, or with an earlier one as the last."""
    years = history_years(spark, path) if years is None else years
    years = tuple(y for y in years if up_to is None or y <= up_to)
    runs = spark.read.parquet(path)
    ended = (F.col(OPEN) == 0) & (F.col(S.SNAPSHOT_YEAR) <= years[-1])
    reaching = (F.col(OPEN) == 1) & (F.col(S.SNAPSHOT_YEAR) == years[-1])
    return History(runs.where(ended | reaching).select(*STATE, FIRST, LAST), years)


def build(series: SnapshotSeries, path: str) -> History:
    """A new table of all snapshots of a series, added one after another.

    The packed rows are written first, by snapshot, in a folder that readers of the table pass over: what the series is derived
    from is then computed once instead of twice for every snapshot.
    """
    spark, years = series.rows.sparkSession, ()
    rows = packed_rows(series.rows.where(F.col(S.SNAPSHOT_YEAR).isin(list(series.years))), S.SNAPSHOT_YEAR)
    sinks.write_scored(rows, f"{path}/{ROWS}", mode="overwrite")
    written = SnapshotSeries(spark.read.schema(rows.schema).parquet(f"{path}/{ROWS}"), series.years)
    for year in series.years:
        years = add_snapshot(spark, path, written.select(year), year, years)
    return read_history(spark, path, years)
