"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import CHECKS  # noqa: E402
from seriesloom.session import build_session  # noqa: E402

HEADLINE = (
    "fact_daily", "baseline", "anomaly", "anomaly_split", "feature_table", "feature_table_split", "targets_long",
    "backtest_metrics", "forecast_rows", "forecast_latest", "city_summary", "city_yearly", "city_recent_daily",
    "long_view", "timeline", "latest_event", "quality_report", "resolve_locations", "upsert", "bronze_silver",
    "merged_normals", "resumed_runs",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": str(2 * int(cpus)),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # One throw-away query, so that the first timed one does not pay for starting up.
    CHECKS["anomaly"].run(spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        started = time.perf_counter()
        CHECKS[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
