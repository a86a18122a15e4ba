"""Joining a one-to-many media extension to the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplevel import schema as S

IDENTIFIER = "identifier"
MEDIA_IDENTIFIER = "multimediaIdentifier"


def any_identifier(media: DataFrame) -> DataFrame:
    """One identifier per record that has any: the smallest, so that reruns agree.

    ``min`` is combined map-side: a record with very many media rows moves as one row per task.
    """
    return (
        media.where(F.col(IDENTIFIER).isNotNull())
        .groupBy(S.RECORD_ID)
        .agg(F.min(IDENTIFIER).alias(MEDIA_IDENTIFIER))
    )


def join_media(occurrences: DataFrame, media: DataFrame) -> DataFrame:
    """Every record with one media identifier, or NULL.

    The extension is grouped to one row per record before the join, so the join cannot multiply
    rows. Both sides grow with the data, so the join is asked to be a sort-merge join: it needs no
    side in memory. The null-safe key gives the grouped side its own shuffle, which lets AQE split a
    heavy or empty id of the record side. A media row without record id matches nothing.
    """
    one = any_identifier(media).where(F.col(S.RECORD_ID).isNotNull())
    one = one.withColumnRenamed(S.RECORD_ID, "_id").hint("merge")
    return occurrences.join(
        one, occurrences[S.RECORD_ID].eqNullSafe(F.col("_id")), "left"
    ).drop("_id")


def join_media_raw(
    occurrences: DataFrame, media: DataFrame, name: str = "mediaIdentifier"
) -> DataFrame:
    """Every record with each of its media identifiers: the plain one-to-many left join.

    Written as an inner join plus the records without media: AQE can split a heavy id on either side
    of an inner join, but not on the many side of a left join. Both joins use the same null-safe key
    on the same columns of the records, so that they read one shuffle of them. Media rows without id
    match nothing and are left out first.
    """
    known = media.where(F.col(S.RECORD_ID).isNotNull())
    many = known.select(F.col(S.RECORD_ID).alias("_id"), F.col(IDENTIFIER).alias(name))
    same = occurrences[S.RECORD_ID].eqNullSafe(F.col("_id"))
    matched = occurrences.join(many, same).drop("_id")
    unmatched = occurrences.join(many.select("_id").distinct(), same, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
