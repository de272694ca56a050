"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds per query.

Each query is worked off into a sink that discards rows.  An untimed run on the
smallest tables beside the given ones (where they exist) warms the code paths, then
the median of $BENCH_RUNS timed runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "terms_in_documents", "extract_facts", "question_stats_lines", "common_phrasing_lines",
    "match_score", "rank_postings", "top_matches", "saved_search_counts", "upsert_postings",
    "compile_plan", "gap_report", "tailor_bullets", "application_state",
)


def main() -> None:
    from vacantia import catalog
    from vacantia.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    small = Path(sf_dir).parent / "sf0.001"
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        if small.is_dir():
            queries[name](spark, str(small)).write.format("noop").mode("overwrite").save()
        for _ in range(runs):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
