"""Headline-query timings: prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default the headline set below).
Each query is planned and fully executed into Spark's ``noop`` sink (no driver
collect). Every query runs twice and the second (warm: JIT-compiled, codegen
cached) time is reported; the cold times are in ``cold``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from qaflow.plans.catalog import Q  # noqa: E402
from qaflow.session import local_session  # noqa: E402

HEADLINE = [
    "rag_pipeline", "topk_dot", "topk_must", "topk_must_should", "contexts", "consolidate_simple",
    "consolidate_overflow", "fallback_references", "redact_documents", "redact_requests", "cache_hits",
    "rerank_by_score", "patch_articles", "eval_log_read", "eval_log_delete", "validate_requests",
    "stage_trace", "build_collection", "retrieve_error_fallback",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="qaflow-bench")
    # warm-up: JVM, Python workers, parquet footers
    Q["topk_dot"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        for store in (cold, times):
            t0 = time.time()
            Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            store[name] = round(time.time() - t0, 3)
    name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf: float | str = float(name)
    except ValueError:
        sf = name
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cold": cold}))
    spark.stop()


if __name__ == "__main__":
    main()
