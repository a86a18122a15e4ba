"""New, moved and vanished records of every interval, kept up as scored files arrive in any order.

The state is a table of observations, rows per record id, snapshot and level, that every micro-batch adds to. A batch
looks up the ids that it holds, counts their changes with and without itself, and writes the difference: rows of a snapshot
that come late take records from vanished to moved, for example. The sum of all differences is what the batch analysis of
all rows so far gives. Each batch has folders of its own and reads only those of the batches before it, so one that is repeated
after a failure writes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.operators.series import N, NEW, OLD, SnapshotSeries, matched_observations, observations
from snaplevel.streaming.incremental import BATCH

STATE, CHANGES = "state", "changes"
KEYS = [S.SNAPSHOT_IDX, OLD, NEW]


def change_totals(obs: DataFrame, n_snapshots: int) -> DataFrame:
    """Per interval (its first index) the rows by old and new level; new ones have no old level, vanished ones no new level.

    Matched rows multiply as in an inner join on the id; rows without id match each other.
    """
    along = Window.partitionBy(S.RECORD_ID).orderBy(S.SNAPSHOT_IDX)
    seen = lambda step: F.count(F.lit(1)).over(along.rangeBetween(step, step)) > 0
    sided = obs.withColumns({"_before": seen(-1), "_after": seen(1)})
    nothing, level = F.lit(None).cast("tinyint"), F.col(S.LEVEL)
    idx = F.col(S.SNAPSHOT_IDX)
    new = sided.where((idx > 0) & ~F.col("_before")).select((idx - 1).alias(S.SNAPSHOT_IDX), nothing.alias(OLD), level.alias(NEW), N)
    gone = sided.where((idx < n_snapshots - 1) & ~F.col("_after")).select(idx.alias(S.SNAPSHOT_IDX), level.alias(OLD), nothing.alias(NEW), N)
    moved = matched_observations(obs).select(*KEYS, N)
    return moved.unionByName(new).unionByName(gone).groupBy(*KEYS).agg(F.sum(N).alias(N))


def run_changes(scored: DataFrame, years: Sequence[int], target: str, checkpoint: str) -> None:
    """Process the available scored records of the given snapshots and stop."""
    years = tuple(sorted(set(years)))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{target}/{STATE}/{BATCH}={batch_id}"
        observations(SnapshotSeries(batch, years), S.LEVEL).write.mode("overwrite").parquet(folder)
        added = spark.read.parquet(folder)
        signed = [(1, added)]
        if batch_id:
            # The observations so far of the ids that the batch holds.
            ids = added.select(F.col(S.RECORD_ID).alias("_id")).distinct()
            state = spark.read.parquet(f"{target}/{STATE}").where(F.col(BATCH) < batch_id).drop(BATCH)
            known = state.join(ids, state[S.RECORD_ID].eqNullSafe(ids["_id"]), "left_semi")
            known = known.groupBy(S.RECORD_ID, S.SNAPSHOT_IDX, S.LEVEL).agg(F.sum(N).alias(N))
            both = known.unionByName(added).groupBy(S.RECORD_ID, S.SNAPSHOT_IDX, S.LEVEL).agg(F.sum(N).alias(N))
            signed = [(1, both), (-1, known)]
        parts = [change_totals(obs, len(years)).withColumn(N, F.col(N) * sign) for sign, obs in signed]
        total = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        total = total.groupBy(*KEYS).agg(F.sum(N).alias(N)).where(F.col(N) != 0)
        total.coalesce(1).write.mode("overwrite").parquet(f"{target}/{CHANGES}/{BATCH}={batch_id}")

    query = (
        scored.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_changes(spark: SparkSession, target: str) -> DataFrame:
    """What every micro-batch changed: its number, the interval's first index, both levels, and rows more or less."""
    schema = f"{S.SNAPSHOT_IDX} int, {OLD} tinyint, {NEW} tinyint, {N} bigint, {BATCH} int"
    return spark.read.schema(schema).parquet(f"{target}/{CHANGES}")


def read_totals(spark: SparkSession, target: str, up_to: int | None = None) -> DataFrame:
    """The changes of all batches, or of those up to one, added up."""
    changes = read_changes(spark, target)
    changes = changes if up_to is None else changes.where(F.col(BATCH) <= up_to)
    return changes.groupBy(*KEYS).agg(F.sum(N).alias(N)).where(F.col(N) != 0)
