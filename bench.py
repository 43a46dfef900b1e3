"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
tables and the local cores. Every query is run to the end into a no-op sink.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loadstone.plans import QUERIES  # noqa: E402
from loadstone.session import local_session  # noqa: E402

HEADLINE = [
    "b3_seasonal_naive_skill", "b1_feature_table", "w3_prior_rolling_stats", "w7_temporal_snapshot", "p7_gap_aware_fill", "p5_implausible_readings", "j9_forecast_weather_overlay",
    "b5_climatology_forecast", "d1_vintage_fold", "a27_scoreability", "a30_benchmark_by_lead", "w14_rolling_drift", "b17_walk_forward_summary", "b7_ensemble_combine",
    "b22_trilinear_interpolation", "a37_national_summary", "t2_top_counterparties", "a7_correlation_matrix", "g6_lttb_downsample",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    QUERIES["f6_cyclical_time"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "event_rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
