"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from featuretable.session import build_session  # noqa: E402
from workload import model_checks  # noqa: E402
from workload.queries import queries  # noqa: E402

HEADLINE = [
    "rollup_review", "basetable", "null_audit", "distinct_profile", "share_by_bucket",
    "fact_join_dim", "business_features", "dedup_by_key", "set_difference", "top_k_reviews",
    "recency_months", "tenure_columns", "precision_recall", "incomplete_report", "fit_logistic",
]
# Best of so many runs, so that compiling and warming up are left out.
REPEATS = {"fit_logistic": 2}


def run(spark, sf_dir: str, name: str) -> float:
    """Seconds from building the plan to the last row."""
    model_checks.forget()
    start = time.perf_counter()
    queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = [run(spark, sf_dir, name) for _ in range(REPEATS.get(name, 3))]
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
