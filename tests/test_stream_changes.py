"""Changes of a stream add up to the batch analysis after every micro-batch, also after a restart."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_history import YEARS, random_rows, same, series_of

from snaplevel import schema as S
from snaplevel.operators.series import N, SnapshotSeries, observations
from snaplevel.streaming import changes


def totals_of(rows, years=YEARS):
    series = SnapshotSeries(rows, years)
    return changes.change_totals(observations(series, S.LEVEL), len(years))


def test_every_batch_and_a_restart(spark, tmp_path):
    rows = random_rows(21)
    random.Random(1).shuffle(rows)  # snapshots arrive mixed up
    whole = series_of(spark, rows).rows
    incoming, target, checkpoint = (str(tmp_path / x) for x in ("incoming", "target", "progress"))
    parts = [rows[k::3] for k in range(3)]
    for k, part in enumerate(parts):
        series_of(spark, part).rows.coalesce(1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
        changes.run_changes(stream, YEARS, target, checkpoint)
        so_far = series_of(spark, [r for p in parts[: k + 1] for r in p]).rows
        same(changes.read_totals(spark, target), totals_of(so_far))
    assert changes.read_changes(spark, target).where(F.col(N) < 0).count() > 0
    same(changes.read_totals(spark, target, up_to=0), totals_of(series_of(spark, parts[0]).rows))
    # Nothing new has come.
    changes.run_changes(spark.readStream.schema(whole.schema).parquet(incoming), YEARS, target, checkpoint)
    same(changes.read_totals(spark, target), totals_of(whole))


def test_new_moved_and_vanished(spark):
    rows = [(1, "d", 0, True, True, 2001), (1, "d", 2, True, True, 2002), (2, "d", 1, True, True, 2001), (3, "d", 3, True, True, 2002)]
    got = {tuple(r) for r in totals_of(series_of(spark, rows).rows, (2001, 2002)).collect()}
    assert got == {(0, 0, 2, 1), (0, 1, None, 1), (0, None, 3, 1)}


def test_no_rows(spark):
    assert totals_of(series_of(spark, []).rows).collect() == []
