"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is planned and run to the end into the ``noop`` sink, which computes every column and collects
nothing. ``queries`` holds the first run of each, in one session started for the bench; ``second_run`` the
times once the JVM is warm, as far as ``SECOND_RUN_BUDGET`` seconds allow.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickerloom import build_session  # noqa: E402
from tickerloom.plans.catalog import all_queries  # noqa: E402

HEADLINE = [
    "bars_from_trades",
    "technical_analysis",
    "historical_analysis",
    "fundamental_with_fallback",
    "news_topk",
    "sentiment_features",
    "macro_combined",
    "sector_macro",
    "interpret_monetary_rate",
    "page_table_extract",
    "company_resolve",
    "intelligence_score",
    "intelligence_rank",
]


SECOND_RUN_BUDGET = 120


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {name: timed(queries[name], spark, folder) for name in HEADLINE}
    warm, started = {}, time.perf_counter()
    for name in HEADLINE:
        if time.perf_counter() - started < SECOND_RUN_BUDGET:
            warm[name] = timed(queries[name], spark, folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "second_run": warm,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
