"""Time the headline queries: one warm-up, then the median of three runs into the ``noop`` sink. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from threadloom.catalog import QUERIES
from threadloom.session import build_session

HEADLINE = ["time_gap_segments", "segment_stats", "thread_conversations", "references", "conversation_refs", "message_pairs", "mention_lookback",
            "short_segment_context", "channel_activity", "mention_names", "upsert_latest", "source_text_hash", "top_words", "topics", "merge_edges", "session_stream", "user_topics"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    names, runs = sys.argv[1:] or HEADLINE, int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", cores=cores, shuffle_partitions=2 * int(cores), memory=os.environ.get("BENCH_MEMORY", "6g"))
    took: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
