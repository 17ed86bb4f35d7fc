"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default the sf0.1 tables) and ``BENCH_CPUS`` (default 8) set the
input and the cores. One short query warms the session before timing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessella.plans.queries import REGISTRY  # noqa: E402
from tessella.scale import session  # noqa: E402

HEADLINE = (
    "tokenize_stats",
    "keyword_search",
    "bm25_topk",
    "vector_topk",
    "hybrid_topk",
    "intake_scan",
    "dispatch_route",
    "composition",
    "appeal_metrics",
    "governance_report",
    "circuit_vote",
    "guardian_gate",
    "calibration_summary",
    "dag_depth",
    "archive_conflicts",
    "pattern_trackers",
    "feedback_thresholds",
    "quarantine_alerts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["quality_filter"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
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
