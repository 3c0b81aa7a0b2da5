"""The jobs that train on gold tables and write their results beside them."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from tradewind.plans import forecast, propensity, segments, serving
from tradewind.plans.models import GoldTables
from tradewind.sources import sinks
from tradewind.sources.scratch import written


def _run(run_id: str | None, scored_at: datetime | None) -> tuple[str, datetime]:
    return run_id or uuid.uuid4().hex, scored_at or datetime.now(timezone.utc)


def write_segments(
    gold: GoldTables, database: str = "gold", run_id: str | None = None, scored_at: datetime | None = None,
    k: int = segments.K_FINAL, restarts: int = segments.RESTARTS,
) -> str:
    """customer_segments. Returns the id of the run, as every job does."""
    run_id, scored_at = _run(run_id, scored_at)
    rows = segments.customer_segments(gold.dim_customers, run_id, scored_at, k, restarts)
    sinks.write_scored(rows, "customer_segments", database)
    return run_id


def write_repeat_scores(
    gold: GoldTables, database: str = "gold", run_id: str | None = None, scored_at: datetime | None = None,
    rounds: int = propensity.ROUNDS,
) -> str:
    """customer_repeat_purchase_scores, repeat_purchase_feature_importance and repeat_purchase_model, from one training."""
    run_id, scored_at = _run(run_id, scored_at)
    prepared = propensity.prepare(gold.repeat_purchase_training)
    model = propensity.fit(prepared, rounds)
    scores = propensity.score_rows(propensity.predict(model, prepared), run_id, scored_at)
    sinks.write_scored(scores, "customer_repeat_purchase_scores", database)
    importance = propensity.importance_rows(model, prepared, run_id, scored_at)
    sinks.write_scored(importance, "repeat_purchase_feature_importance", database)
    sinks.write_scored(propensity.model_rows(model, run_id, scored_at), "repeat_purchase_model", database)
    return run_id


def rescore_repeat(
    gold: GoldTables, database: str = "gold", run_id: str | None = None, scored_at: datetime | None = None
) -> str:
    """customer_repeat_purchase_scores from the stored repeat_purchase_model, without training."""
    run_id, scored_at = _run(run_id, scored_at)
    model = gold.spark.table(f"{database}.repeat_purchase_model")
    prepared = propensity.prepare(gold.repeat_purchase_training)
    scores = propensity.score_rows(propensity.predict(model, prepared), run_id, scored_at)
    sinks.write_scored(scores, "customer_repeat_purchase_scores", database)
    return run_id


def write_forecasts(
    gold: GoldTables, database: str = "gold", run_id: str | None = None, scored_at: datetime | None = None,
    smoothing: bool = False,
) -> str:
    """demand_forecasts of the largest categories, by regression or by smoothing."""
    run_id, scored_at = _run(run_id, scored_at)
    weekly = written(serving.weekly_demand(gold.stg_order_items, gold.fct_orders, gold.dim_products), "weekly")
    split = forecast.holdout_split(forecast.eligible_series(forecast.only_top(weekly)))
    ahead = forecast.smoothing_future(split) if smoothing else forecast.regression_future(split)
    sinks.write_scored(forecast.demand_forecasts(ahead, run_id, scored_at), "demand_forecasts", database)
    return run_id
