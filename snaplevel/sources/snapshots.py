"""Finding and reading scored snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions.labels import parse_snapshot_year
from snaplevel.operators.series import SnapshotSeries


def _plain(path: Column) -> Column:
    """A path without scheme and authority, and without a slash at its end."""
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.regexp_replace(bare, "/+$", "")


def discover_snapshots(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Snapshots of ``folder`` in order of date: dated files in it, or dated folders of files.

    Returns ``snapshot_year``, ``dump`` (the dated name) and ``path``. Only file listings are read,
    not contents. Files and folders further down, such as faulty runs that were put aside in a folder
    of their own, are not snapshots.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    below = F.char_length(_plain(F.lit(folder))) + 2
    inside = F.substring(_plain(F.col("path")), below, F.lit(1 << 30))
    name = F.substring_index(inside, "/", 1)
    depth = F.size(F.split(inside, "/"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    found = files.where(depth <= 2).select(
        parse_snapshot_year(name).alias(S.SNAPSHOT_YEAR),
        name.alias("dump"),
        F.when(depth == 1, F.col("path")).otherwise(parent).alias("path"),
    )
    found = found.where(F.col(S.SNAPSHOT_YEAR).isNotNull()).distinct()
    return found.orderBy("dump", "path")


def read_snapshot(spark: SparkSession, path: str | list[str], year: int) -> DataFrame:
    """One snapshot tagged with its year."""
    files = [path] if isinstance(path, str) else path
    return spark.read.parquet(*files).withColumn(S.SNAPSHOT_YEAR, F.lit(year))


def stack_snapshots(snapshots: dict[int, DataFrame]) -> SnapshotSeries:
    """Snapshots by year as one series. Each branch has a constant year, so filters prune it.

    All must be scored with the same elements: a flag that one of them lacks would be NULL there and
    count as false.
    """
    flags = {y: S.flag_columns(df) for y, df in snapshots.items()}
    every = {f for some in flags.values() for f in some}
    lacking = {y: sorted(every.difference(some)) for y, some in flags.items()}
    if any(lacking.values()):
        some = [f"{y} lacks {', '.join(names)}" for y, names in lacking.items() if names]
        raise ValueError("snapshots are scored with different elements: " + "; ".join(some))
    tagged = [df.withColumn(S.SNAPSHOT_YEAR, F.lit(y)) for y, df in sorted(snapshots.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return SnapshotSeries.of(rows, list(snapshots))


def read_series(spark: SparkSession, folder: str) -> SnapshotSeries:
    """All dated snapshots of a folder, one for each year. The list of snapshots is collected.

    Two dumps of one year are two snapshots, which a series by year can't hold: they are refused.
    """
    by_year: dict[int, list[str]] = {}
    for row in discover_snapshots(spark, folder).collect():
        by_year.setdefault(row[S.SNAPSHOT_YEAR], []).append(row["path"])
    if not by_year:
        raise ValueError(f"no dated snapshot files in {folder}")
    several = [", ".join(paths) for paths in by_year.values() if len(paths) > 1]
    if several:
        raise ValueError("several snapshots of one year: " + "; ".join(several))
    return stack_snapshots({y: spark.read.parquet(*paths) for y, paths in by_year.items()})


def rows_per_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every dated snapshot of a folder, each by itself, also where a year has several."""
    parts = [
        spark.read.parquet(row["path"]).select(F.lit(row["dump"]).alias("dump"))
        for row in discover_snapshots(spark, folder).collect()
    ]
    if not parts:
        raise ValueError(f"no dated snapshot files in {folder}")
    return reduce(DataFrame.unionAll, parts).groupBy("dump").agg(F.count(F.lit(1)).alias("n"))


def read_partitioned_series(spark: SparkSession, folder: str) -> SnapshotSeries:
    """A folder written by ``write_scored``."""
    return SnapshotSeries.of(spark.read.parquet(folder))
