"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: data folder, BENCH_CPUS: cores, BENCH_RUNS: timed runs per query
(the median counts; one more run before them is discarded). Texts that come as
one row group are laid out in a file per core first: a table of any size has
many splits, and the package does not deal out a single one. That time is
given as "layout" and is part of the total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from dwellrank.plans import registry
from dwellrank.session import build_session

HEADLINE = [
    "L5_topk_cosine", "L6_hybrid", "L7_rerank", "L8_pool_maxsim", "T3_word_spans", "T4_sentence_spans", "T6_sentence_chunks",
    "T7_context_chunks", "J2_tier_join", "A12_token_mass", "V6_gaze_distribution", "V8_gaze_attention", "L13_budget_selection",
    "V18_query_chunk_scores", "A11_reward_summary", "J11_paired_rows", "A4_paired_deltas", "A1_grouped_accuracy",
    "J12_retrieval_overlap", "J15_span_coverage", "T15_parsed_answers", "S5_nested_questions",
]


def laid_out(spark, folder: str, cores: int) -> str:
    """The folder's tables, the documents in as many files as cores."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(folder):
        if name == "documents.parquet":
            spark.read.parquet(f"{folder}/{name}").repartition(cores).write.parquet(f"{out}/{name}")
        else:
            os.symlink(f"{folder}/{name}", f"{out}/{name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    registry.load_all()
    spark = build_session("bench", cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    data = laid_out(spark, sf_dir, int(cores))
    layout = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(layout + sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "layout": layout, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
