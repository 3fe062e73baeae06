"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (sf0.1 by default), BENCH_CPUS the local cores, and
BENCH_QUERIES, if set, the queries (comma separated). Every query is run to the end into
a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans.registry import all_queries  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "claims_scan",
    "canonical_claims",
    "missing_report",
    "dq_duplicate_keys",
    "stratified_split",
    "base_features",
    "numeric_stats",
    "onehot_vocabulary",
    "feature_matrix_nnz",
    "location_features",
    "split_safe_location_features",
    "split_safe_attribute_features",
    "graph_counts",
    "shared_location_pairs",
    "related_claims",
    "shared_location_communities",
    "ranking_metrics",
    "threshold_sweep",
    "chunk_documents",
    "topk_cosine",
    "route_questions",
    "graph_evidence",
    "evidence_reports",
    "report_failures",
    "gbt_flags",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "riskloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    plans = all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the session outside the clock
    seconds = {}
    for name in names:
        start = time.perf_counter()
        plans[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    claims = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "claims": claims,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
