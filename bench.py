"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from periodlens.catalog import QUERIES
from periodlens.session import build_session

HEADLINE = (
    "filter_tweets",
    "text_clean_graph",
    "dedup_global",
    "group_periods",
    "period_features",
    "zscore_apply",
    "word_frequency",
    "tfidf_weights",
    "count_per_timestamp",
    "describe_column",
    "evolution_distance",
    "detect_evolution",
    "deviation_window_12",
    "majority_vote",
    "gaussian_smooth",
    "pool_concat",
    "knn_classify",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__periodlens__inputPartitions=cpus
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
