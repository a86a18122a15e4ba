"""Tab-delimited dumps: all columns text, no quoting, malformed rows kept apart.

Quoting is off because the dumps do not quote: a stray quote character would otherwise swallow the
following lines. A line with too few fields is rejected; surplus fields are cut off. Lines are split
independently, so large files split into many tasks.

A dump is a file, a folder or a list of files. Without ``columns`` every file begins with a header
line; files may order the same columns differently. With ``columns`` no file has one. Every other line
is counted, accepted or rejected: a blank line is a row of one empty field, and a data line that reads
like the header is a data line.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplevel.sources import sinks

LINE, FILE, BLOCK_START = "value", "file", "block_start"
SEPARATOR = "\t"
# Partition column of an ingested dump, and the column of a rejected line's number of fields.
ACCEPTED, N_FIELDS = "accepted", "_n_fields"


def _first_lines(alone: bool):
    """The first line of every file; with ``alone`` a task has one file, and what follows the line isn't read."""

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            files = batch[FILE].to_pylist()
            first = [k for k, f in enumerate(files) if f != (files[k - 1] if k else seen)]
            seen = files[-1] if files else seen
            yield batch.take(pa.array(first, pa.int64()))
            if alone and files:
                return

    return first_lines


def header_lines(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files, as ``_metadata.file_path`` spells them, by their header line; files without any line are left out.

    One job with a task for each file, which stops after the first lines. Files whose columns differ by more than their order
    are refused.
    """
    # In a session of its own no file is split and none shares a task, unless these settings are held fast.
    apart = spark.newSession()
    settings = {name: str(1 << 60) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for name, value in settings.items():
        apart.conf.set(name, value)
    alone = all(apart.conf.get(name) == value for name, value in settings.items())
    lines = read_lines(apart, path).where(F.col(BLOCK_START) == 0).select(LINE, FILE)
    found: dict[tuple[str, ...], list[str]] = {}
    first = lines.mapInArrow(_first_lines(alone), lines.schema).collect()
    for row in sorted(first, key=lambda r: unquote(r[FILE])):
        found.setdefault(tuple(row[LINE].split(SEPARATOR)), []).append(row[FILE])
    if not found:
        raise ValueError(f"no lines in {path}")
    if len({tuple(sorted(header)) for header in found}) > 1:
        some = [f"{unquote(files[0])}: {', '.join(header)}" for header, files in found.items()]
        raise ValueError("files of one dump have different columns: " + "; ".join(some))
    return found


def files_by_header(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Paths of files by their header line, see :func:`header_lines`."""
    return {header: list(map(unquote, files)) for header, files in header_lines(spark, path).items()}


def read_header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names of a dump, in the order of its first file."""
    return list(next(iter(files_by_header(spark, path))))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that end in a line feed, or in carriage return and line feed, with their file and block.

    A carriage return elsewhere belongs to its field.
    """
    line = F.col(LINE)
    without_return = F.expr(f"left({LINE}, char_length({LINE}) - 1)")
    return spark.read.text(path, lineSep="\n").select(
        F.when(F.endswith(line, F.lit("\r")), without_return).otherwise(line).alias(LINE),
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK_START),
    )


def _parts(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None
) -> list[tuple[DataFrame, tuple[str, ...], int]]:
    """Lines of files with equal headers, their columns, and how many of the lines are headers."""
    if columns is not None:
        return [(read_lines(spark, path), tuple(columns), 0)]
    by_header = files_by_header(spark, path)
    return [(read_lines(spark, files), header, len(files)) for header, files in by_header.items()]


def _like_header(columns: Sequence[str]) -> Column:
    """Does a line read like the header, in the block where the header is?"""
    return (F.col(LINE) == SEPARATOR.join(columns)) & (F.col(BLOCK_START) == 0)


def _data_lines(lines: DataFrame, columns: Sequence[str], n_headers: int) -> DataFrame:
    """All lines but the headers.

    Lines of a first block that read like the header are equal, so it does not matter which of them is the header:
    as many as there are files are taken off their count, and the rest come back as data.
    """
    rest = lines
    if n_headers:
        alike = lines.where(_like_header(columns)).groupBy(LINE).agg((F.count(F.lit(1)) - n_headers).alias("_n"))
        again = _repeated(alike.where(F.col("_n") > 0), F.col("_n")).select(LINE)
        rest = lines.where(~_like_header(columns)).select(LINE).unionByName(again)
    return rest.select(LINE, F.split(F.col(LINE), SEPARATOR, -1).alias("_fields"))


def _repeated(rows: DataFrame, n: Column, at_once: int = 10_000) -> DataFrame:
    """Every row ``n`` times, unfolded in parts of bounded size."""
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / at_once))))
    size = F.least(F.lit(at_once).cast("bigint"), n - F.col("_part") * at_once)
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))


def _complete(columns: Sequence[str]) -> Column:
    return F.size("_fields") >= len(columns)


def _values(columns: Sequence[str]) -> dict[str, Column]:
    return {c: F.nullif(F.get("_fields", F.lit(i)), F.lit("")) for i, c in enumerate(columns)}


def read_delimited(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Accepted rows, every column a string, empty text as NULL."""
    parts = []
    for lines, names, n_headers in _parts(spark, path, columns):
        rows = _data_lines(lines, names, n_headers).where(_complete(names))
        parts.append(rows.select(*[v.alias(c) for c, v in _values(names).items()]))
    return reduce(DataFrame.unionByName, parts)


def capture_rejects(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rejected lines with the number of fields they have and should have."""
    parts = [
        _data_lines(lines, names, n_headers)
        .where(~_complete(names))
        .select(
            F.col(LINE).alias("line"),
            F.size("_fields").alias("n_fields"),
            F.lit(len(names)).alias("n_expected"),
        )
        for lines, names, n_headers in _parts(spark, path, columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def _ratio(counts: DataFrame) -> DataFrame:
    total = F.col("accepted") + F.col("rejected")
    return counts.withColumn(
        "rejected_ratio",
        F.try_divide(F.col("rejected").cast("double"), total.cast("double")),
    )


def reject_audit(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row: accepted and rejected lines and the rejected share, in one scan.

    Header lines have all fields; as many as there are files are taken off the accepted lines.
    """
    parts = []
    for lines, names, n_headers in _parts(spark, path, columns):
        ok = F.size(F.split(F.col(LINE), SEPARATOR, -1)) >= len(names)
        parts.append(
            lines.agg(
                (F.count_if(ok) - n_headers).alias("accepted"), F.count_if(~ok).alias("rejected")
            )
        )
    both = reduce(DataFrame.unionByName, parts)
    return _ratio(both.agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected")]))


def read_multimedia(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The media extension has the same text form."""
    return read_delimited(spark, path, columns)


def ingest_split(
    spark: SparkSession,
    path: str | list[str],
    target: str,
    rejects: str,
    columns: Sequence[str] | None = None,
    by: str = "basisOfRecord",
) -> DataFrame:
    """Write a dump to Parquet, its rejected lines also as CSV; return the audit.

    One scan writes everything: accepted rows under ``accepted=true``, partitioned by ``by``, and
    rejected lines under ``accepted=false``, from which the CSV is written; the counts are observed on
    the way. Every task writes its own files. Nothing is shuffled, so a dominant value stays spread
    over the tasks. :func:`read_ingested` reads the accepted rows.
    """
    counts = {"accepted": 0, "rejected": 0}
    names: tuple[str, ...] = ()
    for position, (lines, header, n_headers) in enumerate(_parts(spark, path, columns)):
        names = names or header
        n_alike = _write_lines(lines, header, n_headers, target, by, counts, first=position == 0)
        if n_alike:
            text = spark.range(n_alike).select(F.lit(SEPARATOR.join(header)).alias(LINE))
            _write_lines(text, header, 0, target, by, counts, first=False)
    split = spark.read.schema(_ingested_schema(names)).parquet(target).where(~F.col(ACCEPTED))
    sinks.write_csv(
        split.select(
            F.col(LINE).alias("line"),
            F.col(N_FIELDS).alias("n_fields"),
            F.lit(len(names)).alias("n_expected"),
        ),
        rejects,
    )
    audit = spark.range(1).select(
        *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()]
    )
    return _ratio(audit)


def _write_lines(
    lines: DataFrame,
    names: Sequence[str],
    n_headers: int,
    target: str,
    by: str,
    counts: dict[str, int],
    first: bool,
) -> int:
    """Write lines but the headers and count them; the lines that only read like a header are left."""
    is_header = _like_header(names) if n_headers else F.lit(False)
    ok = _complete(names)
    seen = Observation()
    rows = (
        lines.withColumn("_fields", F.split(F.col(LINE), SEPARATOR, -1))
        .observe(
            seen,
            F.count_if(ok & ~is_header).alias("accepted"),
            F.count_if(~ok).alias("rejected"),
            F.count_if(is_header).alias("headers"),
        )
        .where(~is_header)
        .select(
            *[F.when(ok, v).alias(c) for c, v in _values(names).items()],
            F.when(~ok, F.col(LINE)).alias(LINE),
            F.when(~ok, F.size("_fields")).alias(N_FIELDS),
            ok.alias(ACCEPTED),
        )
    )
    mode = "error" if first else "append"
    sinks.write_partitioned(rows, target, ACCEPTED, by, mode=mode)
    found = seen.get
    for name in counts:
        counts[name] += found[name]
    return found["headers"] - n_headers


def _ingested_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType(
        [
            *[T.StructField(c, T.StringType()) for c in names],
            T.StructField(LINE, T.StringType()),
            T.StructField(N_FIELDS, T.IntegerType()),
            T.StructField(ACCEPTED, T.BooleanType()),
        ]
    )


def read_ingested(spark: SparkSession, target: str, columns: Sequence[str]) -> DataFrame:
    """The accepted rows that :func:`ingest_split` wrote."""
    rows = spark.read.schema(_ingested_schema(columns)).parquet(target)
    return rows.where(F.col(ACCEPTED)).select(*columns)
