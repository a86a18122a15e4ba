"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplevel.sources.workdir import work_folder

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch of texts.
BATCH = 1000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder: computed once, whoever is lost later."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of at most BATCH rows, unless the session asks for another size.

    Spark's own 10,000 rows are made for numbers: as many documents, in the memory of a task and of its
    Python process, are a multiple of what the operators work on at a time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(id_column: Column, text: Column) -> Column:
    """A digest that tells rows of another id or text apart; equal rows share it, null differs from empty."""
    return F.md5(
        F.concat(
            F.coalesce(id_column.cast("string"), F.lit("~")),
            F.lit("|"),
            F.when(text.isNull(), "~").otherwise(F.concat(F.lit("="), text)),
        )
    )
