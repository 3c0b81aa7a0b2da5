"""Facts that hold for any right fit, as rows that plain SQL can state too.

A fitted model, a resample or a search by start points has no SQL counterpart, but what its result must
satisfy has: one row per customer, every member nearest to its centre, zero residuals of the normal
equations, metrics that follow from the stored scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.ranking import global_rank
from tradewind.plans import experiments, forecast, propensity, segments
from tradewind.sources.scratch import written

Z_975 = 1.959963984540054


def bootstrap_facts(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, low_near, high_near: the resampled interval lies within half a standard error of the normal one."""
    interval = experiments.bootstrap_interval(experiments.arm_counts(rows, group), "value", group, 0.05)
    gap = F.col("mean_variant") - F.col("mean_control")
    se = F.sqrt(F.col("var_control") / F.col("n_control") + F.col("var_variant") / F.col("n_variant"))
    both = interval.join(experiments.moments(rows, group), list(group))
    return both.select(
        *group,
        (F.abs(F.col("ci_low") - (gap - Z_975 * se)) < se / 2).alias("low_near"),
        (F.abs(F.col("ci_high") - (gap + Z_975 * se)) < se / 2).alias("high_near"),
    )


def normality_facts(tested: DataFrame, group: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """group, sample_n, p_in_range, verdict_follows."""
    p = [F.col("p_control"), F.col("p_variant")]
    return tested.select(
        *group, "sample_n",
        (p[0].between(0, 1) & p[1].between(0, 1)).alias("p_in_range"),
        (F.col("is_normal") == ((p[0] > alpha) & (p[1] > alpha))).alias("verdict_follows"),
    )


def test_facts(result: DataFrame, group: Sequence[str]) -> DataFrame:
    """What a continuous test states that does not depend on samples."""
    return result.select(*group, "test_type", "n_control", "n_variant", "lift", "recommended_sample_size")


def sweep_facts(sweep: DataFrame) -> DataFrame:
    """k, customers, total_cost, converged, in_range, cost_falls.

    total_cost is what lies within and between clusters, per customer: the variance of the features, if
    the sizes, centres and costs belong together. More clusters never cost more.
    """
    before = F.lag("cost").over(Window.orderBy("k"))  # a row per k
    return sweep.select(
        "k", "customers", F.round((F.col("cost") + F.col("between_cost")) / F.col("customers"), 4).alias("total_cost"),
        "converged", F.col("silhouette").between(-1, 1).alias("in_range"),
        F.coalesce(F.col("cost") <= before * 1.0001, F.lit(True)).alias("cost_falls"),
    )


def cluster_facts(customers: DataFrame, k: int = segments.K_FINAL) -> DataFrame:
    """cluster, customers (of all clusters), centre_is_mean, all_nearest."""
    assigned, centers, rested = segments.clustered(customers, k)
    stored = written(assigned, "clusters")
    base = segments.rfm_base(customers)
    scale = segments.scaling(base)
    z = centers.select(
        F.col("cluster").alias("c"),
        *[((F.col(f) - mean) / spread).alias(f"c_{f}") for f, (mean, spread) in scale.items()],
    )

    def gap(to: str):
        return sum(((F.col(f"z_{f}") - F.col(f"{to}_{f}")) ** 2 for f in segments.FEATURES), F.lit(0.0))

    own = stored.crossJoin(F.broadcast(z)).groupBy("customer_unique_id", "cluster").agg(  # k rows
        F.min(gap("c")).alias("least"), F.max(F.when(F.col("c") == F.col("cluster"), gap("c"))).alias("mine")
    )
    nearest = own.groupBy("cluster").agg(F.bool_and(F.col("mine") <= F.col("least") + 1e-9).alias("all_nearest"))
    means = stored.groupBy("cluster").agg(*[F.avg(f"z_{f}").alias(f"z_{f}") for f in segments.FEATURES])
    held = means.join(z, F.col("cluster") == F.col("c")).select("cluster", (gap("c") < 1e-2).alias("centre_is_mean"))
    total = stored.agg(F.count("*").alias("customers"))
    return nearest.join(held, "cluster").crossJoin(F.broadcast(total)).select(  # one row
        "cluster", "customers", (F.col("centre_is_mean") & F.lit(rested)).alias("centre_is_mean"), "all_nearest"
    )


def score_facts(scores: DataFrame) -> DataFrame:
    """customer_unique_id, in_range, follows: one row per customer with a probability and its verdict."""
    p = F.col("repeat_probability")
    return scores.select(
        "customer_unique_id", p.between(0, 1).alias("in_range"),
        (F.col("repeat_prediction") == (p >= propensity.THRESHOLD)).alias("follows"),
    )


def report_facts(predicted: DataFrame) -> DataFrame:
    """held_out, positives, and whether the report's figures follow from the stored scores counted another way."""
    stored = written(predicted, "predicted")
    held_out = stored.filter("not is_train")
    yes, said = F.col("label") == 1, F.col("repeat_prediction")
    # Average places of tied scores, from places that are given out one by one.
    placed = global_rank(held_out, "repeat_probability", "customer_unique_id", "place")
    by_score = placed.groupBy("repeat_probability").agg(F.avg("place").alias("place"), F.count_if(yes).alias("found"))
    places = by_score.agg(F.sum(F.col("place") * F.col("found")).alias("place_sum"))
    cells = held_out.agg(
        F.count("*").alias("held_out"), F.count_if(yes).alias("positives"), F.count_if(yes & said).alias("tp"),
        F.count_if(~yes & said).alias("fp"), F.count_if(yes == said).alias("hits"),
    )
    plain = cells.crossJoin(F.broadcast(places)).selectExpr(  # one row
        "held_out", "positives", "hits / held_out as s_accuracy", "coalesce(try_divide(tp, tp + fp), 0) as s_precision",
        "coalesce(try_divide(tp, positives), 0) as s_recall",
        "try_divide(place_sum - positives * (positives + 1) / 2D, positives * (held_out - positives)) as s_auc",
    )
    pairs = {"accuracy": "s_accuracy", "precision": "s_precision", "recall": "s_recall", "roc_auc": "s_auc"}
    agree = F.lit(True)
    for ours, theirs in pairs.items():
        agree &= (F.abs(F.col(ours) - F.col(theirs)) < 1e-9) | (F.col(ours).isNull() & F.col(theirs).isNull())
    return propensity.report(stored).crossJoin(F.broadcast(plain)).select("held_out", "positives", agree.alias("agree"))  # one row


def importance_facts(importances: DataFrame) -> DataFrame:
    """feature, is_share, whole: each importance is a share, and all of them are 1 together."""
    total = F.sum("importance").over(Window.partitionBy(F.lit(1)))  # a row per feature
    return importances.select(
        "feature", F.col("importance").between(0, 1).alias("is_share"), (F.abs(total - 1) < 1e-4).alias("whole")
    )


def regression_facts(split_rows: DataFrame, order: int = forecast.FOURIER_ORDER) -> DataFrame:
    """category, week, model, solved (the normal equations of the category's fit hold), ordered."""
    residuals = forecast.normal_residuals(split_rows, order).select("category", (F.col("residual") < 1e-6).alias("solved"))
    ahead = forecast.regression_future(split_rows, order)
    return ahead.join(residuals, "category").select("category", "week", "model", "solved", _ordered())


def smoothing_facts(split_rows: DataFrame) -> DataFrame:
    """category, week, finite, floored of the smoothing model's weeks; it gives no interval."""
    ahead = forecast.smoothing_future(split_rows)
    return ahead.select("category", "week", (~F.isnan("yhat")).alias("finite"), (F.col("yhat") >= 0).alias("floored"))


def _ordered():
    inside = F.col("yhat_lower") <= F.greatest("yhat", "yhat_lower")
    return (inside & (F.col("yhat_lower") <= F.col("yhat_upper")) & ~F.isnan("yhat")).alias("ordered")


def metric_facts(metrics: DataFrame) -> DataFrame:
    """category, in_range: no error is negative and smape is at most 2."""
    return metrics.select(
        "category", ((F.col("mae") >= 0) & F.col("smape").between(0, 2) & (F.coalesce("mape", F.lit(0.0)) >= 0)).alias("in_range")
    )
