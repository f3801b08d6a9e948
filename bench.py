"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "graph_stats", "node_degree", "complexity_rank", "layer_dependencies", "arch_violations", "unreachable_files",
    "trace_impact", "all_impact_counts", "bottlenecks", "duplicate_groups_no_shared_helper", "minhash_signature",
    "near_duplicate_groups", "similar_code", "keyword_topk", "rrf_fusion", "context_sections", "clusters",
    "graph_diff_nodes", "incremental_edges", "tool_metrics", "resolve_imports",
]


def main() -> None:
    from graphloom.plans.queries import QUERIES
    from graphloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # start the session before timing
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
