"""Headline queries, timed warm. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEATS (default 1; the
median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from shelfcast.plans import catalog
from shelfcast.session import local_session

HEADLINES = (
    "c06_price_carry_forward",
    "c09_earliest_load",
    "c10_cleaning_metrics",
    "q05_suite",
    "g03_rolling",
    "g04_price_asof",
    "g06_promo_islands",
    "g10_features_master",
    "g11_leakage_audit",
    "e13_baseline_comparison",
    "l05_volume_bands",
    "a01_volume_tier",
    "a09_report_set",
    "i11_replay_days",
    "i13_policy_summary",
    "d02_panel_spine",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)

    def run(name: str) -> float:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in HEADLINES:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total warm wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
