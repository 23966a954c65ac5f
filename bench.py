"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is planned and run from the raw tables; nothing is kept between queries.  The time covers building the
plan and computing every row and column (a write to Spark's ``noop`` sink).  One untimed run warms the JVM up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stockrisk.plans import catalog  # noqa: E402
from stockrisk.session import local_session  # noqa: E402

HEADLINE = [
    "analysis",
    "tasks",
    "dashboard_summary",
    "top_risk_skus",
    "sales_windows",
    "latest_inventory",
    "sku_facts",
    "enriched_analysis",
    "analysis_list",
    "open_tasks",
    "insight_groups",
    "apply_status_updates",
]


def run(name: str, spark, folder: str) -> tuple[float, float]:
    """Seconds in all, and of them until the plan was ready (with what is written on the way)."""
    catalog.model.cache_clear()
    start = time.perf_counter()
    df = catalog.queries()[name](spark, folder)
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, planned - start


def shuffled_bytes(spark) -> int:
    """Bytes written to shuffles since the session started."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    shared = tempfile.mkdtemp(prefix="bench-")  # one machine: a folder that its one executor shares
    spark = local_session(cpus, "bench", **{"spark.driver.memory": "16g", "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    shuffles = {}
    for name in HEADLINE:
        before = shuffled_bytes(spark)
        run(name, spark, folder)
        shuffles[name] = shuffled_bytes(spark) - before
    times, planning, repeats = {}, {}, 3
    for name in HEADLINE:
        best = min(run(name, spark, folder) for _ in range(repeats))
        times[name], planning[name] = (round(x, 3) for x in best)
    match = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, best of 3 each, from raw tables",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(match.group(1)) if match else None,
                "cpus": cpus,
                "planning": planning,
                "shuffle_bytes": shuffles,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
