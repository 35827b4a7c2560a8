"""Headline-query benchmark.

Runs the registered queries below on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is executed in full with the ``noop`` sink (no collect to the driver).
Before timing, every headline query runs once on the smallest data set
($BENCH_WARMUP_DIR, default /root/testdata/sf0.001) so JIT compilation and Python
worker start-up are not charged to the first timed queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "u2_chunk_words", "u1_split_sentences", "p10_normalize_entities", "f10_drop_duplicate_text",
    "m1_extract_keywords", "j7_keyword_search", "j5_knn_join", "j6_multi_query_retrieve",
    "w1_merge_adjacent", "m3_score_batch", "m9_verdict_status", "w4_stratified_exact_sample",
    "l8_stratified_split", "a2_text_length_stats", "a10_binary_metrics", "x3_trending",
    "m10_verify_posts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from factlens.plans.catalog import queries
    from factlens.session import get_spark

    spark = get_spark("factlens-bench", master=f"local[{cpus}]",
                      **{"spark.sql.shuffle.partitions": str(max(int(cpus), 1) * 2)})
    qs = queries()
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm):
        for name in HEADLINE:
            if name in qs:
                qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
