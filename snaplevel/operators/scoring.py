"""Scoring: one narrow projection per record, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import presence
from snaplevel.mappings import MappingSet, default_mapping

# Carried through to the output beside the flags; types of the scored table.
CARRIED = {
    S.RECORD_ID: "bigint",
    S.DATASET: "string",
    S.YEAR: "smallint",
    S.COUNTRY: "string",
    S.PHYLUM: "string",
}


def scan_projected(df: DataFrame, mapping: MappingSet, extra: list[str] | None = None) -> DataFrame:
    """Only the columns that scoring reads and that exist, so that a scan reads nothing else.

    Names are matched without regard to case, and spelled as in the mapping.
    """
    spelled = {c.lower(): c for c in df.columns}
    wanted = dict.fromkeys([*CARRIED, *mapping.columns, *(extra or [])])
    return df.selectExpr(
        *[
            f"{S.quoted(spelled[c.lower()])} AS {S.quoted(c)}"
            for c in wanted
            if c.lower() in spelled
        ]
    )


def clean_properties(df: DataFrame, mapping: MappingSet) -> DataFrame:
    """Mapped columns with sentinels as NULL and a boolean media column as text."""
    return presence.null_sentinels(presence.media_flag_to_text(df), mapping.sentinels)


def _typed(name: str, sql: str) -> Column:
    cast = "cast" if CARRIED[name] == "string" else "try_cast"
    return F.expr(f"{cast}({sql} AS {CARRIED[name]})").alias(name)


def _in_output_order(carried: dict[str, Column], level: Column, flags: list[Column]) -> list[Column]:
    last = (S.YEAR, S.COUNTRY, S.PHYLUM)
    first = [c for name, c in carried.items() if name not in last]
    return [*first, level, *flags, *[carried[name] for name in last]]


def cast_output(df: DataFrame, flags: list[str], extra: list[str] | None = None) -> DataFrame:
    """Fixed column order and types. Text that is no number of the type becomes NULL.

    :func:`cast_casualties` counts those.
    """
    df = presence.add_missing_columns(df, CARRIED)
    typed = {c: _typed(c, S.quoted(c)) for c in CARRIED}
    level = F.col(S.LEVEL).cast("tinyint").alias(S.LEVEL)
    flag_columns = [F.col(S.quoted(f)) for f in flags]
    return df.select(
        *_in_output_order(typed, level, flag_columns), *[F.col(S.quoted(c)) for c in extra or []]
    )


def score_records(
    df: DataFrame, mapping: MappingSet | None = None, extra: list[str] | None = None
) -> DataFrame:
    """Flags and level of every record. Works the same on a batch and on a streaming DataFrame.

    ``extra`` names columns to keep, such as the snapshot year.
    """
    mapping = mapping or default_mapping()
    extra = [c for c in extra or [] if c not in CARRIED]
    rows = presence.media_flag_to_text(scan_projected(df, mapping, extra))
    columns = rows.columns
    flags = [rule.alias(name) for name, rule in presence.compile_rules(mapping, columns).items()]
    level = presence.score_level(mapping, columns).alias(S.LEVEL)
    output = output_columns(columns, mapping, level, flags)
    return rows.select(*output, *[F.col(S.quoted(c)) for c in extra])


def output_columns(
    columns: list[str], mapping: MappingSet, level: Column, flags: list[Column]
) -> list[Column]:
    """Carried columns cleaned and typed, level and flags, in output order.

    Only the carried columns need their cleaned text; the rules test the sentinels themselves.
    """
    carried = {
        c: presence.cleaned_sql(c, mapping.sentinels.get(c, ())) if c in columns else "NULL"
        for c in CARRIED
    }
    return _in_output_order({c: _typed(c, sql) for c, sql in carried.items()}, level, flags)


def cast_casualties(df: DataFrame, mapping: MappingSet | None = None) -> DataFrame:
    """Per numeric output column: how many texts are present but are no number of its type."""
    mapping = mapping or default_mapping()
    cleaned = presence.add_missing_columns(
        clean_properties(scan_projected(df, mapping), mapping), CARRIED
    )
    numeric = {c: t for c, t in CARRIED.items() if t != "string"}
    return cleaned.agg(
        *[
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c)
            for c, t in numeric.items()
        ]
    )
