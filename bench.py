"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run to a sink that takes every row and column. The first run of a query
warms the session and the code paths; the best of the following runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from trovelight.session import build_session

HEADLINE = (
    "context_pack", "vector_topk", "vector_topk_unfiltered", "vector_topk_l2",
    "chunks_regex", "chunks_python", "chunks_javascript", "chunks_all", "chunk_upsert",
    "file_inventory", "repo_languages", "select_repos", "select_files",
    "validate_prompts", "clean_responses", "interaction_log", "embed_corpus",
    "corpus_build", "prompt_answers", "vector_table_search", "stream_upsert", "source_scan",
    "repo_documents", "repo_records",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def seconds(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = int(cpus) if cpus.isdigit() else 8
    spark = build_session("bench", f"local[{cpus}]", parts, spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds(spark, name, sf_dir)
        timings[name] = round(min(seconds(spark, name, sf_dir) for _ in range(RUNS)), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
