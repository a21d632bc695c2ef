"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the number
of timed runs after one warm-up. Reported is the median per query and their sum.
"""

import json
import os
import statistics
import sys
import time

from aerolith import session
from aerolith.plans import QUERIES

HEADLINE = [
    "persistence_metrics", "join_weather_aq", "feature_table", "backfill_training", "targets_time", "aqi_lag_time",
    "new_rows_anti_join", "upsert_latest", "missing_audit", "gap_audit", "diurnal_profile", "box_stats", "aqi_categories",
    "corr_matrix", "acf", "embargo_split", "ts_folds", "smog_weights", "standard_scale", "robust_scale",
    "benchmark_compliance", "analogue_days", "cosine_topk", "stream_tumbling", "stream_lags", "stream_ingest", "score_latest",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"}
    spark = session.build(f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    taken, spread = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        timed = times[1:] or times
        taken[name] = round(statistics.median(timed), 3)
        spread[name] = [round(min(timed), 3), round(max(timed), 3)]
        print(f"{name} {taken[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median query seconds", "value": round(sum(taken.values()), 3), "unit": "sec",
        "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "spread": spread, "cpus": int(cpus), "runs": runs, "conf": conf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
