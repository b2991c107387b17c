"""Time the headline queries and print one JSON line.

All queries run once to warm up the JVM, then each ``BENCH_REPEAT`` times; the median counts, and it
includes building the plan. Results go to Spark's ``noop`` sink, so every row and column is computed
and nothing is gathered on the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from bankspark.plans.queries import QUERIES
from bankspark.session import build_session

HEADLINES = [
    "product_cards", "assigned_instances", "status_timeline", "nightly_status", "init_attributes", "apply_status_fold",
    "account_search", "attribute_values", "contract_facts", "append_ids", "patch_instances", "status_notifications",
    "contract_text", "contract_json_roundtrip", "instance_nested", "clone_products", "stream_status",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(
        "bankspark-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINES:
        run(name)
    seconds = {name: round(statistics.median(run(name) for _ in range(repeat)), 3) for name in HEADLINES}
    spark.stop()
    print(json.dumps({
        "metric": "total_median_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
