"""Queries over fitted and resampled results return the results; what must hold for them is a query of its own."""

import functools
import inspect

import pytest

import __spark_entry__ as contract
from tradewind import queries as registry
from tradewind.plans import facts, propensity, segments
from tradewind.schemas import SCORED

FITTED = {
    "ab_test": {"statistic", "p_value", "ci_low", "ci_high", "conclusion"},
    "ab_bootstrap": {"ci_low", "ci_high"},
    "ab_normality": {"p_control", "p_variant", "is_normal"},
    "customer_segments": set(SCORED["customer_segments"].fieldNames()),
    "silhouette_sweep": {"k", "silhouette", "cost"},
    "repeat_scores": set(SCORED["customer_repeat_purchase_scores"].fieldNames()),
    "propensity_report": {"accuracy", "precision", "recall", "roc_auc", "average_precision"},
    "propensity_importance": {"feature", "importance"},
    "demand_forecast": set(SCORED["demand_forecasts"].fieldNames()),
    "demand_forecast_hw": set(SCORED["demand_forecasts"].fieldNames()),
    "forecast_metrics_seasonal": {"category", "mae", "smape", "mape"},
    "forecast_metrics_hw": {"category", "mae", "smape", "mape"},
}


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(propensity, "fit", functools.partial(propensity.fit, rounds=2))
    monkeypatch.setattr(segments, "silhouette_sweep", functools.partial(segments.silhouette_sweep, ks=[3], restarts=1))
    monkeypatch.setattr(segments, "customer_segments", functools.partial(segments.customer_segments, restarts=1))


@pytest.mark.parametrize("name", sorted(FITTED))
def test_results_are_returned_and_checked(spark, small, quick, name):
    df = contract.queries()[name](spark, small)
    assert FITTED[name] <= set(df.columns) and df.first() is not None
    assert f"{name}_check" in contract.queries() and f"{name}_check" in contract.oracle_sql()
    assert name not in contract.oracle_sql()


@pytest.mark.parametrize("wrong", [False, True])
def test_report_check_ranks_in_buckets_and_sees_a_wrong_figure(spark, monkeypatch, wrong):
    rows = [(f"u{i}", i % 5 == 0, float(i % 3 == 0), (i * 7 % 40) / 40, i * 7 % 40 >= 20) for i in range(400)]
    names = "customer_unique_id string, is_train boolean, label double, repeat_probability double, repeat_prediction boolean"
    if wrong:
        auc = facts.propensity.rank_auc
        monkeypatch.setattr(propensity, "rank_auc", lambda *a: auc(*a).selectExpr("roc_auc + 0.01 as roc_auc"))
    checked = facts.report_facts(spark.createDataFrame(rows, names))
    held_out = [r for r in rows if not r[1]]
    assert checked.first() == (len(held_out), sum(r[2] == 1 for r in held_out), not wrong)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "rank(" in line]
    assert not windows, windows


def test_sweep_restarts_as_often_as_the_final_fit():
    assert inspect.signature(segments.silhouette_sweep).parameters["restarts"].default == segments.RESTARTS == 10
