"""Scoring new files as they arrive, and level counts over the growing result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplevel import schema as S
from snaplevel.mappings import MappingSet
from snaplevel.operators.scoring import score_records
from snaplevel.operators.summary import count_by_key


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder. The limit bounds a micro-batch, not the stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(
    records: DataFrame, mapping: MappingSet | None = None, extra: list[str] | None = None
) -> DataFrame:
    """The batch scorer: it keeps no state, so it needs no streaming form of its own."""
    return score_records(records, mapping, extra)


def run_scoring(scored: DataFrame, target: str, checkpoint: str) -> None:
    """Append the available records to ``target`` and stop. Files and checkpoint give exactly-once."""
    query = (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()


def level_counts_stream(scored: DataFrame) -> DataFrame:
    """Running counts per snapshot and level; the state is one row for each of those."""
    return count_by_key(scored, S.SNAPSHOT_YEAR, S.LEVEL)


BATCH = "batch"


def run_level_counts(counts: DataFrame, target: str, checkpoint: str) -> None:
    """Process the available records and stop; every micro-batch writes the whole table anew.

    Each has a folder of its own under ``target``, so there is a complete table at any moment, and a
    repeated batch writes the same rows over its own folder. The table, one row per snapshot and level,
    is one file, which is there as a whole or not at all. :func:`read_level_counts` reads the last.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")

    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_level_counts(spark: SparkSession, target: str) -> DataFrame:
    """The table of the last complete micro-batch. Only file names are listed to find it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    files = files.option("recursiveFileLookup", "true").load(target)
    number = F.regexp_extract("path", f"/{BATCH}=([0-9]+)/[^/]*$", 1).try_cast("bigint")
    last = files.select(number.alias("n")).agg(F.max("n")).first()[0]
    if last is None:
        raise ValueError(f"no complete table in {target}")
    return spark.read.parquet(f"{target}/{BATCH}={last}")
