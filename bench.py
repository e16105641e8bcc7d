"""Times the headline queries on the given tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from bedtrace.plans import REGISTRY
from bedtrace.session import local_session, release

HEADLINE = [
    "flow_calibrated_error",
    "w1_rolling_mean",
    "w4_lag_lead_filled",
    "w9_gap_fill",
    "j4_interp_join",
    "j5_offset_profile",
    "j8_regrid",
    "j11_dense_bank_idw",
    "a2_group_rmse",
    "a13_segment_offsets",
    "a23_gram_error_correlation",
    "d5_combine_tracks",
    "d11_two_branch_split",
    "d14_robust_projection",
    "d23_prefix_backtest",
    "d34_positive_ridge_stack",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["a1_pooled_rmse"].run(spark, sf_dir).collect()  # warm up the engine, not timed
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        # The noop sink computes every row without bringing any to the driver.
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        release(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
