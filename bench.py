"""Time the headline queries and print one JSON line.

Each query is built anew and written to a no-op sink: one warm-up, then the median of ``BENCH_RUNS``
(default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from atticwork.plans import CATALOG  # noqa: E402
from atticwork.session import build_session  # noqa: E402

HEADLINE = [
    "plate_visits", "visit_groups", "frequent_persons",
    "duplicate_groups", "ranked_copies", "removal_plan_keep_largest",
    "exact_search", "multi_term_search", "regex_search", "search_sections", "fuzzy_sections", "section_texts", "stored_chunks",
    "semantic_search", "nearest_to_each", "nearest_persons",
    "person_counts", "sync_plan", "video_catalog", "video_persons", "person_days", "local_persons", "best_faces",
    "events_media", "event_summaries",
    "sentences_without_copies", "speaker_turns", "packed_sentences", "chunked_corpus", "chunked_tables",
    "transcription_status", "exchange_records",
    "streamed_visits",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    memory = "12g"
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in wanted:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            CATALOG[name](spark, directory).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "driver_memory": memory,
                "spark": pyspark.__version__,
            }
        )
    )


if __name__ == "__main__":
    main()
