"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line.

Every query is run to the end over its whole tables; results go to a sink that discards them. Each is
timed twice and the better time is kept, so that compiling a plan for the first time does not count.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewise import build_session  # noqa: E402
from tracewise.plans.catalog import QUERIES  # noqa: E402

HEADLINE = ("encode_agg", "encode_union_combined", "encode_index", "timestamp_features", "open_cases", "open_cases_scan",
            "ffill", "collapse_rare", "label_predicate", "label_last_of", "split_strict", "prefix_length_counts",
            "prefix_log_table", "sequences", "bucket_state", "auc_by_length", "case_volatility", "rmspd",
            "smooth", "smoothing_sweep", "best_by_auc_stability", "predict_dt")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["read_raw_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        spark.catalog.clearCache()
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
