"""Time the headline queries; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lawspark.plans.queries import QUERIES  # noqa: E402
from lawspark.session import local_session  # noqa: E402

HEADLINE = [
    "token_stats", "bm25_vocab", "bm25_sparse_vectors", "bm25_pair_score", "sparse_topk",
    "dense_topk", "dense_euclid", "hybrid_rrf", "rerank_bm25", "length_histogram",
    "parse_documents", "parse_points", "chunk_points", "chunk_code", "lookup_direct",
    "lookup_inbound", "lookup_outbound", "format_records", "format_context",
    "tool_call_status", "points_build", "points_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(8).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
