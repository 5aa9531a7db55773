"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full through the ``noop`` sink (no collect), after
one warm-up run of the session on the smallest query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "d04_attrition_workflow",     # flagship: count -> share -> assess -> cost
    "a14_table_profile",          # profile with exact distributed quantiles
    "w06_ntile",                  # global ntile without a single-task window
    "e01_metrics_by_threshold",   # metrics for every distinct score
    "e11_gain_lift_deciles",      # gain / lift
    "v07_savings_all_thresholds", # savings for every threshold (prefix sums)
    "v12_sensitivity_grid",       # 30-cell grid in one pass
    "g04_recommend_one_employee", # rule chains
    "d11_discretised_correlation",  # quantile bins + one-hot correlation
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("TURNSTILE_SHUFFLE_PARTITIONS", str(max(8, int(cpus))))
    from turnstile.operators.joins import release_staged
    from turnstile.plans.registry import load_all
    from turnstile.session import build_session

    spark = build_session(master=f"local[{cpus}]", app="turnstile-bench")
    cat = load_all()
    names = [n for n in HEADLINE if n in cat]
    # warm-up of the session (JVM code paths and the Python workers used by
    # the ordered scans) on the smallest data set
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = warm if os.path.isdir(warm) else sf_dir
    for n in ("d04_attrition_workflow", "w06_ntile"):
        cat[n].build(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        cat[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        release_staged(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
