"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query runs once to warm up and then `BENCH_RUNS` times; the fastest full run of the query counts. The result is
written to Spark's no-op sink, so the whole plan runs and nothing passes through the driver.
"""

from __future__ import annotations

import json
import os
import time

from lectern.plans import registry
from lectern.session import local_session

HEADLINE = (
    "flagship_chunks_by_language",
    "u1_segment_text",
    "u3_html_to_text",
    "u4_sanitize_pages",
    "u5_extract_articles",
    "u6_segment_markdown",
    "u9_split_segments",
    "u11_preemptive_split",
    "a1_document_fingerprint",
    "a2_duplicate_documents",
    "a3_assemble_chunks",
    "f4_route_ingest",
    "j6_host_verdict",
    "j7_resolve_redirects",
    "j8_active_anchor",
    "p1_stitch_pcm",
    "a7_latency_budget",
    "w4_recent_entries",
    "w5_running_underruns",
    "w6_degrade_state",
    "w9_session_states",
    "t3_stream_counters",
    "t6_stream_degrade",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"), name="lectern-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        best = float("inf")
        for turn in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if turn:
                best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
