"""Time the headline queries: one JSON line. Reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from podium.plans.registry import QUERIES
from podium.session import local_session

HEADLINE = [
    "report_rows", "apply_changes", "stream_apply_changes", "event_report", "questionnaire", "fold_radio",
    "fold_checkbox", "fold_plaintext", "visible_questions", "answer_bands", "touch_responses", "question_indent",
    "sessions_by_response", "upsert_presenters", "upsert_sessions", "upsert_session_presenters",
    "create_events_options", "insert_questions", "update_questions", "init_responses", "assign_ids",
    "delete_events", "write_event_reports", "dq_unique", "dq_foreign_keys", "dq_not_null_length",
]
SLOW = {"stream_apply_changes", "write_event_reports"}


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(spark, name, folder)
        times = [run(spark, name, folder) for _ in range(1 if name in SLOW else repeats)]
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries, median after one warm-up",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
