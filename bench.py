"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Every query is built
anew, run once to warm up and then timed twice, the better time counting; the
result goes to a sink that reads all of it. The first run of the flagship query is reported as its cold time.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from backdate.plans.queries import named_queries
from backdate.session import local_session

HEADLINE = [
    "indicators_panel",
    "price_history",
    "price_snapshot",
    "facts_as_of",
    "facts_naive_latest",
    "news_top_k",
    "build_versions",
    "apply_batch_prices",
    "lookahead_leaks",
    "stored_rows",
    "ingest_facts_unpivot",
    "ingest_news_dedup",
    "truncate_sentences",
    "compare_runs",
    "comparison_summary",
    "research_panel",
    "baseline_prompts",
    "final_attempts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = named_queries()

    def seconds(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    cold = seconds(HEADLINE[0])
    timed = {}
    for name in HEADLINE:
        seconds(name)
        timed[name] = round(min(seconds(name), seconds(name)), 3)
    print(json.dumps({
        "metric": "total warm time of the headline queries",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "cold": {HEADLINE[0]: round(cold, 3)},
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
