"""Lines of a dump that a line feed inside a field has broken, put together again.

A record of w fields has w - 1 separators. A line with fewer is a part of a record, or spoilt. Along a file, parts are
added up: a line with some separators begins a record; the lines after it join it while the sum stays below w - 1, and
the line that brings it to w - 1 completes it. A line that brings it beyond begins anew, and a whole line ends it; what was open
then stays rejected. A line without separators never begins a record, as a record begins with its id.

The work is done by blocks, the pieces in which Spark reads a file. One scan numbers the lines of each block and keeps
the short ones; all that follows sees only these. Neighbouring short lines of a block are one run, folded by itself. A run at
the head of a block depends on the state that the block before leaves open, which is one value unless that block has
only short lines; such a block is a function of the state before it, a value for each state, and these are applied one
after another. So the result is that of one pass over the file, and no task sees more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaplevel.sources import text
from snaplevel.sources.workdir import work_folder

FILE, START, BLOCK, K = "file", "start", "block", "k"
PLACE = [FILE, BLOCK, K]
#: The state between two lines: separators of the open record, or -1, and the place of its first line.
STATE = "struct<c: int, block: bigint, k: bigint>"
_NOTHING = f"cast(named_struct('c', -1, 'block', null, 'k', null) AS {STATE})"
_DONE = "array<struct<block: bigint, k: bigint, last: bigint>>"


def _step(width: int) -> tuple[str, str]:
    """How the state goes on with a line x of the run; the second text tells whether the line completes a record."""
    whole = width - 1
    joins = "a.state.c >= 0 AND a.state.c + x.s"
    state = (
        f"CASE WHEN {joins} < {whole} THEN named_struct('c', a.state.c + x.s, 'block', a.state.block, 'k', a.state.k)"
        f" WHEN {joins} = {whole} OR x.s = 0 THEN {_NOTHING}"
        " ELSE named_struct('c', x.s, 'block', block, 'k', x.k) END"
    )
    return f"cast({state} AS {STATE})", f"{joins} = {whole}"


def _folded(width: int, before: str) -> Column:
    """The state after a run, and the records that its lines complete, from the state before it."""
    state, complete = _step(width)
    record = "named_struct('block', a.state.block, 'k', a.state.k, 'last', x.k)"
    done = f"CASE WHEN {complete} THEN concat(a.done, cast(array({record}) AS {_DONE})) ELSE a.done END"
    first = f"named_struct('state', {before}, 'done', cast(array() AS {_DONE}))"
    return F.expr(f"aggregate(parts, {first}, (a, x) -> named_struct('state', {state}, 'done', {done}))")


def _function(width: int) -> Column:
    """The state after a run for every state before it; a record that stays open from before has no place."""
    state, _ = _step(width)
    first = f"named_struct('state', cast(named_struct('c', c0, 'block', null, 'k', null) AS {STATE}))"
    after = f"aggregate(parts, {first}, (a, x) -> named_struct('state', {state}), a -> a.state)"
    return F.expr(f"transform(sequence(-1, {width - 2}), c0 -> {after})")


#: The states before each of the blocks of a chain, in order.
_BEFORE = f"""aggregate(chain, named_struct('now', coalesce(chain[0].earlier, {_NOTHING}), 'before', cast(array() AS array<{STATE}>)),
  (a, x) -> named_struct(
    'now', cast(CASE WHEN x.whole IS NULL OR x.whole[a.now.c + 1].c < 0 THEN {_NOTHING}
           ELSE named_struct('c', x.whole[a.now.c + 1].c,
             'block', coalesce(x.whole[a.now.c + 1].block, a.now.block), 'k', coalesce(x.whole[a.now.c + 1].k, a.now.k)) END AS {STATE}),
    'before', concat(a.before, array(a.now))),
  a -> a.before)"""


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Repair:
    """What one pass over a dump gives: ``repaired`` records, ``rejects`` that remain, and an ``audit``."""

    spark: SparkSession
    path: str | list[str]
    headers: dict[tuple[str, ...], list[str]]
    with_headers: bool

    @property
    def names(self) -> list[str]:
        return list(next(iter(self.headers)))

    @cached_property
    def _blocks(self) -> DataFrame:
        """A row per block: file, its number in the file, lines, and the short lines in order."""
        width = len(self.names)
        lines = text.read_lines(self.spark, self.path).withColumn("id", F.monotonically_increasing_id())
        n = F.size(F.split(F.col(text.LINE), text.SEPARATOR, -1)) - 1
        short = F.when(n < width - 1, F.struct("id", n.alias("s"), F.col(text.LINE).alias("line")))
        found = lines.groupBy(F.col(text.FILE).alias(FILE), F.col(text.BLOCK_START).alias(START)).agg(
            F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.collect_list(short).alias("short")
        )
        found = _saved(found, "repair-blocks")
        # One row for each block of a file.
        number = F.row_number().over(Window.partitionBy(FILE).orderBy(START)).cast("bigint").alias(BLOCK)
        numbers = found.select(FILE, START, number)
        return found.join(numbers, [FILE, START])

    @cached_property
    def _lines(self) -> DataFrame:
        """The short lines with their place: file, block, position in the block."""
        each = self._blocks.select(FILE, BLOCK, "n", "first", F.explode("short").alias("x"))
        return each.select(FILE, BLOCK, "n", (F.col("x.id") - F.col("first")).alias(K), "x.s", "x.line")

    @cached_property
    def _members(self) -> DataFrame:
        """The place of every line of a repaired record, and that of the record's first line."""
        width = len(self.names)
        place = Window.partitionBy(FILE, BLOCK).orderBy(K)
        runs = self._lines.select(FILE, BLOCK, "n", K, "s", (F.col(K) - F.row_number().over(place)).alias("run"))
        runs = runs.groupBy(FILE, BLOCK, "run").agg(
            F.first("n").alias("n"),
            F.min(K).alias("low"),
            F.max(K).alias("high"),
            F.array_sort(F.collect_list(F.struct(K, "s"))).alias("parts"),
        )
        runs = _saved(runs, "repair-runs")
        to_end = F.col("high") == F.col("n") - 1
        is_whole = to_end & (F.col("low") == 0)
        ends = runs.where(to_end).select(
            FILE,
            BLOCK,
            F.when(~is_whole, _folded(width, _NOTHING)["state"]).alias("after"),
            F.when(is_whole, _function(width)).alias("whole"),
        )
        # A chain: blocks of short lines only, and the block after them. One row for each block.
        along = Window.partitionBy(FILE).orderBy(BLOCK)
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        blocks = self._blocks.select(FILE, BLOCK).join(ends, [FILE, BLOCK], "left").select(
            FILE,
            BLOCK,
            "whole",
            F.lag("after").over(along).alias("earlier"),
            F.coalesce(F.count_if(F.col("whole").isNull()).over(before), F.lit(0)).alias("number"),
        )
        chains = blocks.groupBy(FILE, "number").agg(F.array_sort(F.collect_list(F.struct(BLOCK, "whole", "earlier"))).alias("chain"))
        each = F.expr("transform(chain, (x, i) -> named_struct('block', x.block, 'before', states[i]))")
        states = chains.withColumn("states", F.expr(_BEFORE)).select(FILE, F.explode(each).alias("x"))
        states = states.select(FILE, "x.block", "x.before").where("before.c >= 0")

        heads = runs.join(states, [FILE, BLOCK], "left")
        heads = heads.withColumn("before", F.when(F.col("low") == 0, F.col("before")))
        done = heads.select(FILE, F.col(BLOCK).alias("until"), F.explode(_folded(width, f"coalesce(before, {_NOTHING})")["done"]).alias("r"))
        done = done.select(FILE, "until", F.col("r.block").alias("of_block"), F.col("r.k").alias("of_k"), F.col("r.last").alias("last"))
        each = done.withColumn(BLOCK, F.explode(F.sequence("of_block", "until")))
        sizes = self._blocks.select(FILE, BLOCK, "n")
        low = F.when(F.col(BLOCK) == F.col("of_block"), F.col("of_k")).otherwise(F.lit(0))
        high = F.when(F.col(BLOCK) == F.col("until"), F.col("last")).otherwise(F.col("n") - 1)
        members = each.join(sizes, [FILE, BLOCK]).select(FILE, BLOCK, F.explode(F.sequence(low, high)).alias(K), "of_block", "of_k")
        return _saved(members, "repair-members")

    @cached_property
    def _records(self) -> DataFrame:
        """File, fields and number of lines of every repaired record."""
        parts = self._lines.join(self._members, PLACE).groupBy(FILE, "of_block", "of_k")
        parts = parts.agg(F.array_sort(F.collect_list(F.struct(BLOCK, K, "line"))).alias("x"))
        line = F.array_join(F.col("x.line"), "\n")
        return parts.select(FILE, F.split(line, text.SEPARATOR, -1).alias("_fields"), F.size("x").alias("n_lines"))

    @property
    def repaired(self) -> DataFrame:
        """Repaired rows, every column a string, empty text as NULL; the fields keep their line feeds."""
        variant = F.lit(0)
        for k, files in enumerate(self.headers.values()):
            if k:
                variant = F.when(F.col(FILE).isin(files), k).otherwise(variant)
        rows = self._records.withColumn("_variant", variant)

        def value(name: str) -> Column:
            at = F.lit(0)
            for k, header in enumerate(self.headers):
                at = F.when(F.col("_variant") == k, header.index(name)).otherwise(at)
            return F.nullif(F.get("_fields", at), F.lit("")).alias(name)

        return rows.select(*map(value, self.names))

    @property
    def rows(self) -> DataFrame:
        """Accepted and repaired rows."""
        columns = None if self.with_headers else self.names
        return text.read_delimited(self.spark, self.path, columns).unionByName(self.repaired)

    @property
    def rejects(self) -> DataFrame:
        """Rejected lines with the number of fields they have and should have."""
        left = self._lines.join(self._members, PLACE, "left_anti")
        return left.select("line", (F.col("s") + 1).alias("n_fields"), F.lit(len(self.names)).alias("n_expected"))

    @property
    def audit(self) -> DataFrame:
        """One row: accepted lines, repaired records and their lines, rejected lines; headers are none of these."""
        n_headers = sum(map(len, self.headers.values())) if self.with_headers else 0
        first = (F.col(BLOCK) == F.col("of_block")) & (F.col(K) == F.col("of_k"))
        counts = ["lines", "short", "repaired", "repaired_lines"]
        of = lambda df, **found: df.agg(*[F.coalesce(found.get(c, F.lit(0)), F.lit(0)).cast("bigint").alias(c) for c in counts])
        lines = of(self._blocks, lines=F.sum("n"), short=F.sum(F.size("short")))
        members = of(self._members, repaired=F.count_if(first), repaired_lines=F.count(F.lit(1)))
        return lines.unionByName(members).agg(*[F.sum(c).alias(c) for c in counts]).select(
            (F.col("lines") - F.col("short") - n_headers).alias("accepted"),
            "repaired",
            "repaired_lines",
            (F.col("short") - F.col("repaired_lines")).alias("rejected"),
        )


def repair_lines(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> Repair:
    """The repair of a dump; with ``columns`` its files have no header line. Tables are written under the work folder."""
    if columns is not None:
        return Repair(spark, path, {tuple(columns): []}, with_headers=False)
    return Repair(spark, path, text.header_lines(spark, path), with_headers=True)
