"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); BENCH_QUERIES may name other queries of the catalog.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from taskloom.plans.catalog import CATALOG  # noqa: E402
from taskloom.session import build_session  # noqa: E402

HEADLINE = (
    "tool_stats tool_calls session_progress ready_tasks compressible_logs recover_stale tool_grants purge_compressed check_sql "
    "search_memory search_tools build_messages next_actions ingest_actions ingest_tasks enqueue resolve_approvals"
).split()


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = build_session(f"local[{cpus}]", partitions=cpus, driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["tool_stats"](spark, directory).write.format("noop").mode("overwrite").save()  # warm-up: JVM, codegen, file listing
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
