"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Each query is run once to warm up and then timed; the time covers plan building, the
measuring jobs of split operators and the full result.
"""

from __future__ import annotations

import json
import os
import time

from seriesmill.registered import QUERIES
from seriesmill.session import build_session

HEADLINE = [
    "a1_align_hourly",
    "a5_accuracy_hourly",
    "a6_accuracy_daily",
    "a8_consumption_hourly",
    "a9_prices_daily",
    "a12_performance_hourly",
    "a28_pivot_forecasts",
    "f13_training_features",
    "f17_prediction_dataset",
    "f18_consumption_training_table",
    "i1_ingest_actuals",
    "j1_merge_series",
    "j2_asof_nearest",
    "j3_asof_backward_keyed",
    "j8_price_comparison",
    "k1_upsert_power",
    "r1_hourly_stream",
    "s9_decode_observations",
    "w1_lags_keyed",
    "w2_rolling_keyed",
    "w6_forward_fill_keyed",
    "w7_latest_run",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
