"""Records that come back under another id.

An id of the earlier snapshot that the later one lacks, and one that only the later one has, may be the same record. Rules
tell which: columns that must be present and equal, and columns that should agree as well. The rules are tried in order, each
first with the columns that should agree, then without. Where several ids are left on both sides, the smallest ones go
together, then the next ones: each is the other's best match among those that remain, ties broken by id. An id is
matched once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import presence
from snaplevel.operators.ranks import RANK, ranked
from snaplevel.sources.workdir import work_folder

OLD_ID, NEW_ID, RULE, AGREED = "old_id", "new_id", "rule", "agreed"


@dataclass(frozen=True)
class MatchRule:
    """``keys`` must be present and equal; ``agree`` may be absent on both sides."""

    name: str
    keys: tuple[str, ...]
    agree: tuple[str, ...] = ()


DEFAULT_RULES = (
    MatchRule("catalogue", ("institutionCode", "catalogNumber"), (S.DATASET, "scientificName")),
    MatchRule("collector", ("recordedBy", "recordNumber", "year"), (S.COUNTRY, "institutionCode")),
)
MISSING = ("", "unknown:undigitized")


def one_sided(previous: DataFrame, current: DataFrame, columns: Sequence[str], missing: Mapping[str, Sequence[str]]) -> DataFrame:
    """Ids that only one of the snapshots has: id, whether it is new, and the columns with missing texts as NULL.

    Of an id that occurs several times the first values count, in the order of the columns. Rows without id are left out. One
    shuffle on the id, combined before it.
    """

    def side(df: DataFrame, is_new: bool) -> DataFrame:
        texts = [F.expr(presence.cleaned_sql(c, missing.get(c, MISSING))).alias(c) for c in columns]
        return df.where(F.col(S.RECORD_ID).isNotNull()).select(S.RECORD_ID, F.lit(is_new).alias("_new"), F.struct(*texts).alias("_row"))

    both = side(previous, False).unionByName(side(current, True)).groupBy(S.RECORD_ID)
    found = both.agg(F.min("_new").alias("_new"), F.max("_new").alias("_last"), F.min("_row").alias("_row"))
    return found.where(F.col("_new") == F.col("_last")).select(S.RECORD_ID, "_new", "_row.*")


def _matches(rows: DataFrame, keys: Sequence[str], agree: Sequence[str]) -> DataFrame:
    """(old id, new id) of the equal ranks of both sides of every block."""
    by = [*keys, *agree]
    present = reduce(Column.__and__, [F.col(c).isNotNull() for c in keys])
    numbered = ranked(rows.where(present).select(S.RECORD_ID, "_new", *by), ["_new", *by], [S.RECORD_ID])
    old = numbered.where(~F.col("_new"))
    new = numbered.where("_new").select(F.col(S.RECORD_ID).alias(NEW_ID), F.col(RANK).alias("_rank"), *[F.col(c).alias(f"_{c}") for c in by])
    same = reduce(Column.__and__, [old[c].eqNullSafe(new[f"_{c}"]) for c in by], old[RANK] == new["_rank"])
    return old.join(new, same).select(F.col(S.RECORD_ID).alias(OLD_ID), NEW_ID)


def changed_ids(
    previous: DataFrame,
    current: DataFrame,
    rules: Sequence[MatchRule] = DEFAULT_RULES,
    missing: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``old_id``, ``new_id``, the ``rule`` that matched them, and whether all its columns ``agreed``.

    ``missing`` gives the texts that count as missing per column; empty text and "unknown:undigitized" where it says nothing.
    Blocks may be of any size: their ids are numbered in ranges, and no pairs of a block are formed but those that match.
    """
    spark = previous.sparkSession
    columns = list(dict.fromkeys(c for r in rules for c in (*r.keys, *r.agree)))
    left = _saved(one_sided(previous, current, columns, missing or {}), "one-sided")
    found: DataFrame | None = None
    for rule in rules:
        for agree in ([rule.agree, ()] if rule.agree else [()]):
            pairs = _matches(left, rule.keys, agree).select(
                OLD_ID, NEW_ID, F.lit(rule.name).alias(RULE), F.lit(agree == rule.agree).alias(AGREED)
            )
            pairs = _saved(pairs, "matches")
            found = pairs if found is None else found.unionByName(pairs)
            gone = pairs.select(F.explode(F.array(OLD_ID, NEW_ID)).alias("_gone"))
            left = _saved(left.join(gone, left[S.RECORD_ID] == gone["_gone"], "left_anti"), "unmatched")
    if found is None:
        raise ValueError("no rules")
    return found


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
