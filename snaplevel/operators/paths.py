"""Whole paths of records through the levels, counted, and the tree of their beginnings.

A record's state in a snapshot is its rows by level: mostly one row of one level, none where the snapshot lacks the
record, several where its id repeats. The rows without id are one record of their own. A path is the states in all
snapshots. Paths come from the history table, one shuffle on the id; there are few different ones, so everything after that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.operators.history import FIRST, LAST, History
from snaplevel.operators.series import N, NEW, OLD

PATH, RECORDS = "path", "n_records"
#: How a snapshot without the record is written; between snapshots.
ABSENT, THEN = "-", ">"


def level_paths(history: History) -> DataFrame:
    """``path``, an array with the rows by level of every snapshot, and how many records take it."""
    runs = history.rows.groupBy(S.RECORD_ID, S.LEVEL, FIRST, LAST).agg(F.sum(N).alias(N))
    runs = runs.groupBy(S.RECORD_ID).agg(F.collect_list(F.struct(S.LEVEL, FIRST, LAST, N)).alias("_runs"))

    def state(idx: Column) -> Column:
        """Rows by level, levels in order; those that several runs share are added up."""
        here = F.filter("_runs", lambda r: (r[FIRST] <= idx) & (r[LAST] >= idx))
        levels = F.array_sort(F.array_distinct(F.transform(here, lambda r: r[S.LEVEL])))

        def rows(level: Column) -> Column:
            mine = F.filter(here, lambda r: r[S.LEVEL].eqNullSafe(level))
            n = F.aggregate(mine, F.lit(0).cast("bigint"), lambda total, r: total + r[N])
            return F.struct(level.alias(S.LEVEL), n.alias(N))

        return F.transform(levels, rows)

    every = F.sequence(F.lit(0), F.lit(len(history.years) - 1))
    return runs.groupBy(F.transform(every, state).alias(PATH)).agg(F.count(F.lit(1)).alias(RECORDS))


def path_text(path: Column) -> Column:
    """Such as ``->0>0>1+2x3``: absent, level 0 twice, then one row of level 1 and three of level 2."""

    def rows(r: Column) -> Column:
        level = F.coalesce(r[S.LEVEL].cast("string"), F.lit("?"))
        return F.when(r[N] == 1, level).otherwise(F.concat(level, F.lit("x"), r[N].cast("string")))

    states = F.transform(path, lambda s: F.when(F.size(s) == 0, ABSENT).otherwise(F.array_join(F.transform(s, rows), "+")))
    return F.array_join(states, THEN)


def path_tree(paths: DataFrame) -> DataFrame:
    """The tree of beginnings: ``depth``, ``node`` and ``parent`` as text, records, and their share of the parent's (0-1).

    The root, depth 0, is not a row; the parent of its children is ''.
    """
    depths = F.sequence(F.lit(1), F.size(PATH))
    each = paths.select(RECORDS, PATH, F.explode(depths).alias("depth"))
    begun = F.slice(PATH, F.lit(1), F.col("depth"))
    nodes = each.groupBy("depth", begun.alias("node")).agg(F.sum(RECORDS).alias(RECORDS))
    parent = F.slice("node", F.lit(1), F.col("depth") - 1)
    totals = nodes.select((F.col("depth") + 1).alias("depth"), path_text(F.col("node")).alias("parent"), F.col(RECORDS).alias("_of"))
    root = paths.agg(F.sum(RECORDS).alias("_of")).select(F.lit(1).alias("depth"), F.lit("").alias("parent"), "_of")
    named = nodes.select("depth", path_text(F.col("node")).alias("node"), path_text(parent).alias("parent"), RECORDS)
    both = named.join(totals.unionByName(root), ["depth", "parent"])
    return both.select("depth", "node", "parent", RECORDS, (F.col(RECORDS) / F.col("_of")).alias("share"))


def path_transitions(paths: DataFrame) -> DataFrame:
    """The two-step marginals: row pairs of neighbouring snapshots by both levels, as :meth:`History.transition_totals` has them."""
    steps = F.sequence(F.lit(0), F.size(PATH) - 2)
    each = paths.where(F.size(PATH) > 1).select(RECORDS, PATH, F.explode(steps).alias(S.SNAPSHOT_IDX))
    each = each.select(RECORDS, S.SNAPSHOT_IDX, F.explode(F.get(PATH, S.SNAPSHOT_IDX)).alias("a"), F.get(PATH, F.col(S.SNAPSHOT_IDX) + 1).alias("_next"))
    each = each.select(RECORDS, S.SNAPSHOT_IDX, "a", F.explode("_next").alias("b"))
    keys = [S.SNAPSHOT_IDX, F.col(f"a.{S.LEVEL}").alias(OLD), F.col(f"b.{S.LEVEL}").alias(NEW)]
    return each.groupBy(*keys).agg(F.sum(F.col(RECORDS) * F.col(f"a.{N}") * F.col(f"b.{N}")).alias(N))
