"""Time the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
Every query runs in full into the noop sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from checks.frames import Frames  # noqa: E402
from checks.registry import QUERIES  # noqa: E402
from checks.whole_run import headline  # noqa: E402

HEADLINE = [
    "normalize_events", "tool_calls", "skill_invocations", "session_rollup", "attach_results",
    "scrub", "build_payloads", "tool_sequences",
    "signal_bloat", "signal_compaction_proximity", "signal_redundant_reads",
    "signal_skill_eligible_missed", "signal_skill_abandoned", "signal_skill_turnaround",
    "signal_recurring_sequences", "signal_correction_clusters",
    "top_bloat", "skill_health_all", "rollup_tools", "session_timeline_with_subagents",
    "dashboard", "skill_evidence",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, cpus)
    run(spark, "sessions_by_project", sf_dir)  # start-up is not part of the figures
    start = time.perf_counter()
    headline(Frames(spark, sf_dir))
    whole = round(time.perf_counter() - start, 3)  # files written, two loads, all signals, two queries
    times = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    times["whole_run"] = whole
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
