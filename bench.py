"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the warm runs per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitrina.session import build_session  # noqa: E402

HEADLINE = (
    "clean_text", "parse_price", "split_valid_rows", "impute_group_mean", "row_max_fill", "trim_outliers", "dedupe_by_keys",
    "join_brand_kind", "min_over_name", "mean_line", "box_stats_cv", "group_corr", "kde", "name_price_stats", "daily_mean",
    "profile_columns", "stl_decompose", "leader_groups", "tfidf", "recommend_text", "recommend_hybrid", "lexicon_polarity",
    "count_vectors", "product_cards", "reviews_article",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    from vitrina.plans.catalog import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("daily_mean")  # starts the executors and compiles the common paths
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    times = {name: round(statistics.median(run(name) for _ in range(runs)), 3) for name in only or HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
