"""Time the headline queries from raw tables to result; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is run in full into a sink that discards rows. BENCH_QUERIES=a,b limits the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tradewind.queries import queries  # noqa: E402
from tradewind.session import local_session  # noqa: E402
from tradewind.sources import scratch  # noqa: E402

HEADLINE = [
    "revenue_by_month", "orders_by_state", "kpis", "fct_orders", "fct_order_items", "dim_customers",
    "customer_cohorts", "cohort_retention", "seller_performance", "repeat_training", "top_customers",
    "weekly_demand", "category_revenue_top", "ltv_percentiles", "ltv_histogram", "rfm_score", "rfm_correlation",
    "threshold_sweep", "roc_auc", "average_precision", "ab_proportion", "ab_welch", "ab_mannwhitney",
    "ab_bootstrap", "ab_test", "demand_forecast", "demand_forecast_hw", "customer_segments", "silhouette_sweep",
    "repeat_scores", "dq_relationships", "dq_not_null", "dq_unique", "stream_orders",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    known = queries()
    known["revenue_by_month"](spark, directory).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    took = {}
    for name in names:
        started = time.perf_counter()
        known[name](spark, directory).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    scratch.release(spark)
    print(
        json.dumps(
            {
                "metric": "headline queries, raw tables to result",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
