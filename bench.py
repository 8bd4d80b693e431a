"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.catalog import QUERIES
from tidemark.session import local_session

HEADLINE = [
    "bm25_topk", "hybrid_topk", "cosine_topk", "keyword_coverage_topk", "sentence_chunks", "conversation_chunks",
    "retrieval_metrics", "khop_edges", "mention_match", "latency_stats", "report_latency", "entity_merge",
    "source_union_dedup", "history_compaction", "asof_fact", "capture_flushes", "leaderboard_rank", "term_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), app="bench")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    warm = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001"))
    seconds = {}
    for name in names:
        # Each query runs once on the smallest tables, so that the timed run measures warm code.
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
