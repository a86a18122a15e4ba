"""Writers. Each writes a folder from all tasks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from snaplevel import schema as S


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "error") -> None:
    """Parquet/zstd in ``column=value`` folders, without a shuffle."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def write_scored(df: DataFrame, path: str, mode: str = "error") -> None:
    """Scored snapshots partitioned by ``snapshot_year``, so that one snapshot is one folder."""
    write_partitioned(df, path, S.SNAPSHOT_YEAR, mode=mode)


def save_bucketed(df: DataFrame, table: str, buckets: int, mode: str = "errorifexists") -> None:
    """Scored snapshots as a table bucketed by record id.

    The shuffle on the record id is then paid once, when writing: series functions read the table
    without another one. Use as many buckets as keep one bucket of all snapshots within a task's
    memory, and prefer the plain folder when one id may repeat millions of times.
    """
    (
        df.write.mode(mode)
        .option("compression", "zstd")
        .bucketBy(buckets, S.RECORD_ID)
        .sortBy(S.RECORD_ID)
        .saveAsTable(table)
    )


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Tab-separated with header, NULL as nothing."""
    df.write.mode(mode).csv(
        path, sep="\t", header=True, nullValue="", emptyValue="", escape='"'
    )


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Comma-separated with header; quotes within text are doubled."""
    df.write.mode(mode).csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, by: str = S.SNAPSHOT_YEAR, mode: str = "error") -> None:
    """One JSON object per line, one folder per value of ``by``.

    One array per snapshot would gather a whole snapshot's groups in one task; a folder of lines per
    snapshot holds the same records.
    """
    df.write.mode(mode).partitionBy(by).json(path)
