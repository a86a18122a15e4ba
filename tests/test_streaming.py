from __future__ import annotations

from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.operators.scoring import score_records
from snaplevel.operators.summary import count_by_key
from snaplevel.streaming import (
    level_counts_stream, read_level_counts, read_stream, run_level_counts, run_scoring,
    score_stream,
)


def records(spark, first, last):
    ids = spark.range(first, last)
    return ids.select(
        F.col("id").cast("string").alias("gbifID"),
        F.lit("d").alias("datasetKey"),
        F.when(F.col("id") % 4 != 0, "c").alias("catalogNumber"),
        F.when(F.col("id") % 3 != 0, "i").otherwise("").alias("institutionCode"),
        F.lit(2020).alias("snapshot_year"),
    )


def counts(df):
    return {(r[S.SNAPSHOT_YEAR], r[S.LEVEL]): r["n"] for r in df.collect()}


def test_increments_equal_one_batch(spark, tmp_path):
    incoming, target = str(tmp_path / "in"), str(tmp_path / "scored")
    totals, marks = str(tmp_path / "totals"), [str(tmp_path / "c1"), str(tmp_path / "c2")]
    schema = records(spark, 0, 1).schema
    for first, last in ((0, 100), (100, 250)):
        records(spark, first, last).repartition(3).write.mode("append").parquet(incoming)
        scored = score_stream(read_stream(spark, incoming, schema, 1), extra=["snapshot_year"])
        run_scoring(scored, target, marks[0])
        run_level_counts(level_counts_stream(scored), totals, marks[1])
        batch = score_records(spark.read.parquet(incoming), extra=["snapshot_year"])
        expected = counts(count_by_key(batch, S.SNAPSHOT_YEAR, S.LEVEL))
        assert spark.read.parquet(target).count() == last
        assert counts(read_level_counts(spark, totals)) == expected
        assert counts(count_by_key(spark.read.parquet(target), S.SNAPSHOT_YEAR, S.LEVEL)) == expected
