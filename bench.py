"""Time the headline queries: one warm-up, then the median of three runs each.

Reads ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8) and ``BENCH_QUERIES`` (a comma list;
default the headline set). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "daily_rollup",
    "daily_panel",
    "customer_labels",
    "monthly_features",
    "salary_imputation",
    "table_profile",
    "nzv",
    "mahalanobis",
    "downsample",
    "ordered_split",
    "ibcf_similarity",
    "ibcf_predict",
    "auc_exact",
    "auc_interval",
    "score_customers",
    "product_models",
]


def main() -> None:
    from inclina.catalog import QUERIES
    from inclina.session import get_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session(
        "inclina-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for attempt in range(2 if name == "product_models" else 4):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale or 0)}))


if __name__ == "__main__":
    main()
