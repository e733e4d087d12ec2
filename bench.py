"""Wall seconds of the registered queries, as one JSON line.

BENCH_SF_DIR: input folder. BENCH_CPUS: local cores. BENCH_QUERIES: comma-separated names
(default: the headline queries; "all" for every query). BENCH_RUNS: timed runs after one
warm-up run; the median is reported. Results go to the noop sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from skarn.plans import QUERIES
from skarn.session import local_session

HEADLINE = [
    "describe_numeric",
    "correlation_matrix",
    "dedup_last_wins",
    "segment_profile",
    "kmeans_lloyd_3",
    "kmeans_segments",
    "kmeans_elbow",
    "tokenize_docs",
    "lexicon_polarity",
    "lexicon_polarity_rules",
    "sentiment_by_rating",
    "rating_ci_bootstrap",
    "score_quantiles_by_rating",
    "pairwise_corr_by_rating",
    "top_disagreement_1_model",
    "model_scores",
    "text_classifier_scores",
    "tag_tokens",
    "entity_spans",
    "row_index_ticks",
    "lag_features",
    "lag_features_ticks",
    "history_windows_ticks",
    "asof_ticks",
    "zscore_series",
    "ar3_forecast",
    "window60_forecast",
    "recursive_forecast",
    "price_downsample",
]


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = HEADLINE if not wanted else list(QUERIES) if wanted == "all" else wanted.split(",")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    if cpus.isdigit():
        spark.conf.set("skarn.inputPartitions", cpus)  # the tables are one split each
    timed = {}
    for name in names:
        seconds(QUERIES[name], spark, sf_dir)
        timed[name] = round(statistics.median(seconds(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
        print(name, timed[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
