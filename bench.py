"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

`queries` are end to end: each derives its snapshot series from the given tables, scores it and analyses
it. `operators` start from tables that are written once: scoring from raw rows, with the rate in rows per
second, the analyses from scored rows, and one of them from a table bucketed by record id.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snaplevel.operators import cube, history, masks
from snaplevel.operators.scoring import score_records
from snaplevel.operators.series import SnapshotSeries
from snaplevel.plans import analyses as A
from snaplevel.registry import tables
from snaplevel.registry.queries import QUERIES
from snaplevel.schema import LEVEL, RECORD_ID, SNAPSHOT_YEAR
from snaplevel.sources import sinks, snapshots
from snaplevel.sources.workdir import work_folder

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "score_records",
    "snapshot_summary",
    "element_trend_fraction",
    "new_record_levels",
    "new_record_elements",
    "level_transitions",
    "decline_severity",
    "top_level_drop",
    "base_cohort_levels",
    "intake_cohort_levels",
    "levels_by_dataset_size",
    "kingdom_completeness",
    "continent_completeness",
    "period_completeness",
    "media_join",
    "ingest_split",
    "write_scored",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("snaplevel-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-warehouse-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


ANALYSES = {
    "element_trend_fraction": A.element_trend_fraction,
    "new_record_elements": A.new_record_elements,
    "level_transitions": A.level_transitions,
    "decline_severity": A.decline_severity,
    "base_cohort_levels": A.base_cohort_levels,
    "intake_cohort_levels": A.intake_cohort_levels,
}


def timed(make: Callable[[], DataFrame]) -> float:
    """Best of a few runs, plan building included, every result row produced and dropped."""
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return best


def operators(spark: SparkSession) -> dict[str, float]:
    path, scored = work_folder(spark, "bench-raw"), work_folder(spark, "bench-scored")
    tables.raw_series(spark, FOLDER).write.parquet(path)
    raw = spark.read.parquet(path)
    n_rows = raw.count()
    seconds = timed(lambda: score_records(raw, extra=[SNAPSHOT_YEAR]))
    found = {"score_raw_rows": seconds, "score_raw_rows_per_second": n_rows / seconds, "raw_rows": n_rows}
    found["raw_columns"] = len(raw.columns)
    sinks.write_scored(score_records(raw, extra=[SNAPSHOT_YEAR]), scored)
    series = snapshots.read_partitioned_series(spark, scored)
    for name, analysis in ANALYSES.items():
        found[f"{name}_of_scored"] = timed(lambda analysis=analysis: analysis(series))
    table = "bench_bucketed"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    sinks.save_bucketed(series.rows, table, int(CPUS))
    bucketed = SnapshotSeries.of(spark.table(table), series.years)
    found["level_transitions_of_bucketed"] = timed(lambda: A.level_transitions(bucketed))
    spark.sql(f"DROP TABLE {table}")

    # The last snapshot joins a history of those before; then the analyses read the runs.
    path = work_folder(spark, "bench-history")
    years = ()
    for year in series.years:
        start = time.perf_counter()
        years = history.add_snapshot(spark, path, series.select(year), year, years)
    found["history_add_last_snapshot"] = time.perf_counter() - start
    runs = history.read_history(spark, path, years)
    for name in ("level_transitions", "base_cohort_levels", "intake_cohort_levels"):
        found[f"{name}_of_history"] = timed(lambda name=name: ANALYSES[name](runs))

    mappings, path = tables.mapping_sets(), work_folder(spark, "bench-masks")
    found["score_eight_sets_one_by_one"] = sum(
        timed(lambda m=m: score_records(raw, m).select(LEVEL)) for m in mappings.values()
    )
    found["presence_masks"] = timed(lambda: masks.presence_masks(raw, list(mappings.values()), [SNAPSHOT_YEAR]))
    masks.presence_masks(raw, list(mappings.values()), [SNAPSHOT_YEAR]).write.parquet(path)
    masked = spark.read.parquet(path)
    found["score_eight_sets_from_masks"] = timed(lambda: masks.levels_of_all(masked, mappings, [RECORD_ID]))
    found["cube"] = timed(lambda: cube.cube_of(series.rows).rows)
    return {name: round(value, 3) for name, value in found.items()}


def main() -> None:
    spark = session()
    spark.read.parquet(f"{FOLDER}/region.parquet").count()
    seconds = {name: round(timed(lambda name=name: QUERIES[name](spark, FOLDER)), 3) for name in HEADLINE}
    of_tables = operators(spark)
    spark.stop()
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "operators": of_tables,
                "sf": float(scale),
            }
        )
    )


if __name__ == "__main__":
    main()
