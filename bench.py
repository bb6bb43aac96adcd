"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, optional).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gapwise.session import local_session  # noqa: E402
from gapwise.workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "missing_profile", "inject_mcar", "inject_mar", "inject_mnar", "listwise", "pairwise_corr", "impute_mean",
    "impute_median", "impute_mode", "impute_knn_uniform", "impute_knn_orders", "impute_knn_cells",
    "pattern_statistics", "impute_regression_2", "impute_regression_noise", "impute_iterative",
    "impute_iterative_gaps", "impute_em", "impute_em_gaps", "impute_random_forest", "impute_gradient_boosting",
    "impute_multiple", "impute_multiple_gaps", "describe_before_after", "histogram_shared",
    "correlation_before_after", "method_comparison", "full_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gapwise-bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start executor threads before timing
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
