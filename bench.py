"""Headline queries, each written to the noop sink: median of three runs after one warm-up.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sql01_revenue_by_category",
    "sql02_monthly_revenue",
    "sql03_cancellation_by_fulfilment",
    "sql04_b2b_performance",
    "sql05_top_states",
    "agg16_sku_stock_performance",
    "agg21_executive_summary",
    "agg22_rfm_per_order",
    "agg26_upper_quartile",
    "win01_rolling_revenue",
    "win01_rolling_revenue_split",
    "win04_rfm_score",
    "join01_category_stock",
    "join02_sku_stock",
    "ml01_engineered_features",
    "sta01_welch_statistics",
    "prf05_describe_numeric",
    "flt02_drop_duplicates",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from salesloom.plans import QUERIES, runnable
    from salesloom.session import local_session
    from salesloom.sources.canonical import Tables
    from salesloom.workspace import drop_staged

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus)
    runs = {"canonical_sales": lambda: Tables(spark, sf_dir).sales}
    for name in HEADLINE:
        runs[name] = lambda build=runnable(QUERIES[name]): build(spark, sf_dir)
    times = {}
    for name, run in runs.items():
        seconds(run)
        times[name] = round(statistics.median(seconds(run) for _ in range(3)), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
