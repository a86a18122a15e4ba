"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel.sources.workdir import work_folder

SLICE, RANK = "_slice", "rank"


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rank`` from 1 of each row among those that agree in ``by`` (nulls agree), in the given order.

    ``order`` must tell the rows of a group apart. The rows are dealt out by ranges of group and order, so that a group that holds a
    third of them is many slices; a slice numbers its own, and the slices before it are added. Of the slices only
    their counts per group are compared.
    """
    spark = df.sparkSession
    keys = [*by, *order]
    path = work_folder(spark, "ranks")
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    dealt.withColumn(SLICE, F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    here = dealt.withColumn("_here", F.row_number().over(Window.partitionBy(SLICE, *by).orderBy(*order)))
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(SLICE, *by).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(
        F.col(SLICE).alias("_s"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = reduce(Column.__and__, [here[c].eqNullSafe(counts[f"_by_{c}"]) for c in by], here[SLICE] == counts["_s"])
    return here.join(counts, same).select(*df.columns, (F.col("_here") + F.col("_before")).alias(RANK))
