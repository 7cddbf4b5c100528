"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from galeledger.catalog import REGISTRY  # noqa: E402
from galeledger.session import local_session  # noqa: E402

HEADLINE = [
    "a3_capture_factor", "a6_curtailment_rate", "a13_p95_per_quarter", "a13_quantiles_large_groups", "a19_quantile_bands",
    "c6_monthly_revenue", "c9_irr", "c10_yearly_table", "d9_hourly_dense", "d15_cadence", "a9_hourly_two_thirds", "f2_price_path",
    "f2_capture_path", "f10_price_bands", "f11_bootstrap", "g_heatmap", "j1_equi_join", "j5_asof_backward", "j6_asof_nearest", "j8_interval_flag",
    "j12_power_curve", "j13_bilinear", "m1_price_ar", "m12_error_metrics", "n1_sniffed_number", "s1_market_export", "w2_keep_last",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run = lambda name: REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("a1_monthly_mean")  # start the JVM's code paths before timing
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
