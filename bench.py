"""Time the headline queries from the raw files and print one JSON line.

Every measurement starts without derived tables, so it covers the whole path from the
test tables to the result.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from monthloom.plans import catalog  # noqa: E402
from monthloom.session import local_session  # noqa: E402
from monthloom.staging import release_staged  # noqa: E402

HEADLINE = (
    "slice_momentum_spread", "fea_01_monthly_features", "jon_01_interval_join",
    "jon_03_link_interval_join", "fea_05_panel_build", "agg_06_quantile_profile",
    "agg_09_coverage_by_year", "agg_14_monthly_correlations", "win_13_winsorize",
    "pf_04_wide_assignments", "pf_05_decile_returns", "pf_06_extreme_portfolios",
    "ic_01_rank_ic", "tc_04_reconstruction", "agg_27_cost_summary",
    "inf_04_long_short_differences", "oos_03_time_cv", "oos_04_expanding_long",
    "ml_01_elastic_net", "ml_02_boosted_trees", "dq_16_panel_metadata",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cores)
    catalog.load()
    catalog.run(HEADLINE[0], spark, folder).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            catalog.forget_tables()
            start = time.perf_counter()
            catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            release_staged(spark)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
