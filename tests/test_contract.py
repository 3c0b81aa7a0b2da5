import pytest

import __spark_entry__ as contract
from checks.compare import canonical, differences, duck
from tradewind.plans import serving

# One or two queries per part; `python -m checks.compare` runs all of them.
NAMES = [
    "stg_orders", "int_orders_enriched", "fct_order_items", "dim_customers", "customer_cohorts", "seller_performance",
    "repeat_training", "kpis", "cohort_pivot", "bottom_customers", "ltv_percentiles", "weekly_demand", "delivery_sla",
    "rfm_correlation", "dq_accepted_values", "ab_proportion", "ab_welch", "ab_mannwhitney", "rfm_quintiles",
    "segment_summary", "propensity_features", "roc_auc", "average_precision", "forecast_metrics", "stream_orders",
    "replay_timestamps", "ingest_csv",
]


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).columns == ["order_month", "revenue", "order_count"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small, name):
    df = contract.queries()[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    found = differences(canonical(df.columns, rows), canonical(*duck(contract.oracle_sql()[name], small)))
    assert not found, found


def test_scan_reads_only_what_the_flagship_needs(spark, small):
    plan = contract.queries()["revenue_by_month"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in plan and "l_linenumber" not in plan and "CartesianProduct" not in plan


def test_top_k_is_a_bounded_sort(spark, small):
    from tradewind.queries import models

    plan = serving.ranked_customers(models(spark, small).dim_customers)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
