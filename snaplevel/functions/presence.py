"""Presence tests: source columns to element flags and a level."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplevel.mappings.model import Element, MappingSet
from snaplevel.schema import LEVELS, quoted

MEDIA_FLAG = "multimedia"


def null_sentinels(df: DataFrame, sentinels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each column's sentinel texts by NULL. Exact match: no trimming, case-sensitive."""
    present = set(df.columns)
    cleaned = {
        c: F.expr(cleaned_sql(c, values))
        for c, values in sentinels.items()
        if c in present and values
    }
    return df.withColumns(cleaned) if cleaned else df


def add_missing_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Add absent columns as NULL strings, so that a rule on them is false rather than an error."""
    present = set(df.columns)
    absent = [c for c in dict.fromkeys(columns) if c not in present]
    return df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df


def media_flag_to_text(df: DataFrame, column: str = MEDIA_FLAG) -> DataFrame:
    """A true/false media column becomes 'T' or NULL, so that false counts as missing."""
    if column not in df.columns:
        return df
    flag = F.col(quoted(column))
    if not isinstance(df.schema[column].dataType, T.BooleanType):
        flag = flag == "TRUE"
    return df.withColumn(column, F.when(flag, "T"))


def strip_class_prefix(column: Column) -> Column:
    """Text after the last colon."""
    return F.regexp_replace(column, "^.*:", "")


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def present_sql(column: str, sentinels: Sequence[str] = ()) -> str:
    """Condition: the column is neither NULL nor one of its sentinels. Never NULL itself."""
    name = quoted(column)
    if not sentinels:
        return f"{name} IS NOT NULL"
    return f"coalesce({name} NOT IN ({', '.join(map(sql_text, sentinels))}), false)"


def cleaned_sql(column: str, sentinels: Sequence[str] = ()) -> str:
    """The column with its sentinels as NULL."""
    if not sentinels:
        return quoted(column)
    return f"CASE WHEN {present_sql(column, sentinels)} THEN {quoted(column)} END"


def element_rule(
    element: Element, available: Iterable[str], sentinels: Mapping[str, Sequence[str]] | None = None
) -> str:
    """The element's rule as one SQL condition; a column that is not available is never present.

    Sentinels are tested inside the condition, so the texts need not be cleaned before.
    """
    have, missing_texts = set(available), sentinels or {}

    def holds(columns: Sequence[str], negated: bool) -> str:
        if all(c in have for c in columns):
            every = " AND ".join(present_sql(c, missing_texts.get(c, ())) for c in columns)
        else:
            every = "false"
        return f"(NOT ({every}))" if negated else f"({every})"

    return " OR ".join(holds(a.columns, a.negated) for a in element.alternatives)


def compile_rules(mapping: MappingSet, available: Iterable[str]) -> dict[str, Column]:
    """Flag name to boolean expression, in mapping order. The flags are never NULL.

    The two casts change no value. They keep a flag from being the very expression that the level
    repeats: Catalyst derives a constraint for every way to replace rules by flags in the level, so
    eighteen equal expressions would make 2^18 of them whenever a filter follows.
    """
    have = list(available)
    return {
        e.flag: F.expr(
            f"cast(cast(({element_rule(e, have, mapping.sentinels)}) AS tinyint) AS boolean)"
        )
        for e in mapping.elements
    }


def all_of_row(flags: Sequence[str]) -> Column:
    """True when every named flag of the row is true."""
    return F.expr(" AND ".join(map(quoted, flags)) or "true")


def score_level(mapping: MappingSet, available: Iterable[str] | None = None) -> Column:
    """Cumulative level: the highest one for which all flags up to that level are true, else -1.

    A level without elements asks for nothing and is reached with the one below it.

    With ``available`` the rules themselves are spelled out instead of the flag columns. Selected
    beside the flags, every rule is then a common subexpression, which Spark compiles into a small
    method of its own; one projection of the whole mapping would otherwise outgrow the size that the
    JVM still compiles. The level is a sum rather than a CASE because only unconditional expressions
    are shared.
    """
    have = None if available is None else list(available)

    def condition(element: Element) -> str:
        if have is None:
            return quoted(element.flag)
        return f"({element_rule(element, have, mapping.sentinels)})"

    steps, so_far = [], []
    for level in LEVELS[1:]:
        so_far += [condition(e) for e in mapping.elements if e.level == level]
        steps.append(f"if({' AND '.join(so_far) or 'true'}, 1, 0)")
    return F.expr(f"cast({' + '.join(['-1', *steps])} as tinyint)")


FLAGS_PER_NUMBER = 63


def pack_flags(flags: Sequence[str]) -> Column:
    """All flags of a row as numbers, 63 flags each (bit i of number k is flag 63 k + i).

    A row format with fixed 8-byte slots would otherwise spend 8 bytes on every boolean of a shuffle.
    """
    numbers = []
    for start in range(0, max(1, len(flags)), FLAGS_PER_NUMBER):
        some = flags[start : start + FLAGS_PER_NUMBER]
        bits = [f"if({quoted(f)}, {1 << i}L, 0L)" for i, f in enumerate(some)]
        numbers.append(F.expr(" | ".join(bits) or "0L"))
    return F.array(*numbers)


def packed_flag(packed: Column, position: int) -> Column:
    """1 when the flag at ``position`` is set in packed flags, else 0."""
    number, bit = divmod(position, FLAGS_PER_NUMBER)
    return F.getbit(F.get(packed, F.lit(number)), F.lit(bit)).cast("bigint")
