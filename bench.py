"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_RUNS the timed runs per query
(the median counts) after one warm-up run. Every run builds its plan anew and executes it completely
through the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from epitide.catalog import all_queries  # noqa: E402
from epitide.catalog.assembling import catalog  # noqa: E402
from epitide.catalog.modelling import NUMERIC, training_rows  # noqa: E402
from epitide.catalog.views import Views  # noqa: E402
from epitide.plans import forecasting  # noqa: E402
from epitide.session import configure  # noqa: E402

HEADLINE = (
    "snk01_partitioned_overwrite", "sca30_json_record", "sca32_whole_term_match", "sca41_page_metadata", "joi02_left_multi_key", "joi03_asof_backward",
    "joi05_frequency_covariates", "joi09_indicator_outer_pivot", "agg07_matrix_daily",
    "agg16_duplicate_provenance", "agg20_regression_metrics", "agg21_guarded_correlation", "win01_keep_latest",
    "win11_exact_date_target", "win14_trailing_zero_run", "win16_bounded_interpolation", "pip01_cumulative_reports", "pip11_indicator_catalog",
    "pip12_canonical_observations", "pip14_multi_frequency_features", "pip15_risk_score", "qlt08_source_reconciliation", "mlt04_baseline_comparison", "mlt09_sequence_training_set",
    "qry05_weather_correlation", "qry07_rankings",
)


def timed_builds(spark: SparkSession, folder: str) -> dict[str, float]:
    """Seconds of what the queries above only read: the feature and catalog tables and one fit of 60 trees."""
    views = Views(configure(spark), folder)
    rows = training_rows(views).where("split = 'train'").cache()
    rows.count()
    steps = {
        "gold_features": lambda: views.features.write.format("noop").mode("overwrite").save(),
        "indicator_catalog": lambda: catalog(views).write.format("noop").mode("overwrite").save(),
        "fit_60_trees": lambda: forecasting.fit_gbt(rows, forecasting.usable_numeric(rows, NUMERIC)),
    }
    out = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        out[name] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    table = {q.name: q for q in all_queries()}
    wanted = [n for n in HEADLINE if not sys.argv[1:] or any(p in n for p in sys.argv[1:])]
    seconds: dict[str, float] = {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            table[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    builds = timed_builds(spark, folder)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "builds": builds, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
