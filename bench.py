"""Wall time of the headline queries; prints one JSON line.

Each query is written to the ``noop`` sink, so that all rows are computed and none are collected.
The first one runs once before the clock starts, to load the classes that every query shares.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace import registry  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = (
    "high_value_customers", "sales_daily", "customer_ltv", "upsert_customer_ltv", "merge_balances",
    "incremental_events", "monthly_revenue", "agg_family", "rank_customers", "row_number_orders", "running_total",
    "pivot_status", "unpivot_measures", "cross_apply_top_orders", "nested_subquery", "hierarchy_levels",
    "stmt_catalog", "stmt_levels", "pattern_hits", "pattern_warnings", "nesting_depth", "model_columns",
    "source_catalog", "dbt_levels", "model_closure", "impact_all_columns", "critical_path", "rename_impact",
    "breaking_changes", "column_trace", "trace_rollup", "lineage_neighbours",
)


def timed(query, spark, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "millrace-bench")
    queries = registry.queries()
    timed(queries[HEADLINE[0]], spark, folder)
    times = {name: round(timed(queries[name], spark, folder), 3) for name in sys.argv[1:] or HEADLINE}
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
