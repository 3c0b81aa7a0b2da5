"""Repeat-purchase propensity: leakage-safe features, boosted trees, ranking metrics, scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import keyed_order
from tradewind.operators import boosting
from tradewind.operators.quantiles import median
from tradewind.operators.ranking import average_precision, global_rank, rank_auc
from tradewind.plans.serving import confusion_metrics
from tradewind.sources.scratch import written
from tradewind.sources.sinks import fit_schema

# The features in their order, and the columns that would leak the label.
FEATURES = [
    "frequency",
    "monetary",
    "avg_order_value",
    "tenure_days",
    "recency_at_T",
    "max_installments_used",
    "used_credit_card",
    "used_boleto",
    "used_voucher",
    "avg_review_score",
    "reviewed_order_count",
    "has_review",
]
BANNED = frozenset({"last_order_date", "recency_days", "snapshot_date", "outcome_end_date", "horizon_days"})

SEED = 42
TRAIN_PERCENT = 80
ROUNDS = 200
THRESHOLD = 0.5
MODEL_VERSION = "boosted_v2"


def split(training: DataFrame, seed: int = SEED) -> DataFrame:
    """training plus is_train: 80 % of each class, rounded, by the order of a keyed hash; the same on every run.

    Rows without a label are not trained on.
    """
    y = F.col("will_repeat").cast("int")
    keyed = training.withColumns({"__y": y, "__k": keyed_order(seed, F.col("customer_unique_id"))})
    sizes = training.agg(F.count(F.when(y == 0, 1)).alias("__n0"), F.count(F.when(y == 1, 1)).alias("__n1"))
    first = F.col("__y") == 0
    place = F.when(first, F.col("__place")).otherwise(F.col("__place") - F.col("__n0"))
    size = F.when(first, F.col("__n0")).otherwise(F.col("__n1"))
    return (
        global_rank(keyed, "__y", "__k", "__place")
        .crossJoin(F.broadcast(sizes))  # one row
        .withColumn("is_train", F.coalesce(100 * place <= TRAIN_PERCENT * size + 50, F.lit(False)))
        .drop("__y", "__k", "__place", "__n0", "__n1")
    )


def review_median(training: DataFrame) -> DataFrame:
    """One row: the median review score of the training part only."""
    return median(training.filter("is_train"), "avg_review_score").withColumnRenamed("median", "review_median")


def features(split_rows: DataFrame, medians: DataFrame) -> DataFrame:
    """customer_unique_id, is_train, label and the twelve features, none of them NULL."""
    reviewed = split_rows.crossJoin(F.broadcast(medians)).withColumn(  # one row
        "has_review", F.col("avg_review_score").isNotNull().cast("int")
    )
    filled = reviewed.withColumn("avg_review_score", F.coalesce("avg_review_score", "review_median"))
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    return filled.select(
        "customer_unique_id", "is_train", F.col("will_repeat").cast("double").alias("label"), *columns
    )


def class_weights(split_rows: DataFrame) -> DataFrame:
    """One row over the training part: positives, negatives, weight of a positive."""
    y = F.col("will_repeat").cast("int")
    return split_rows.filter("is_train").agg(
        F.sum(y).alias("n_pos"),
        F.sum(1 - y).alias("n_neg"),
        F.coalesce(F.try_divide(F.sum(1 - y).cast("double"), F.sum(y).cast("double")), F.lit(1.0)).alias("pos_weight"),
    )


def check_trainable(prepared: DataFrame) -> None:
    """Stop before training on one class only, or with a column that leaks the label."""
    leaked = set(prepared.columns) & BANNED
    if leaked:
        raise ValueError(f"leakage columns in features: {sorted(leaked)}")
    base_rate = prepared.agg(F.avg("label")).first()[0]
    if base_rate is None or not 0 < base_rate < 1:
        raise ValueError(f"label has no variance (base rate {base_rate})")


def prepare(training: DataFrame, seed: int = SEED) -> DataFrame:
    """Split, imputed, weighted feature rows, written once: training reads them many times."""
    stored = written(split(training, seed), "training")
    weights = class_weights(stored).select("pos_weight")
    return written(
        features(stored, review_median(stored))
        .crossJoin(F.broadcast(weights))  # one row
        .withColumn("weight", F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(1.0))
        .drop("pos_weight"),
        "features",
    )


def fit(
    prepared: DataFrame, rounds: int = ROUNDS, seed: int = SEED, shard_rows: int = boosting.SHARD_ROWS,
    most_shards: int = boosting.SHARDS,
) -> DataFrame:
    """Boosted trees over the training part, as a stored table of nodes."""
    check_trainable(prepared.select("label", *FEATURES))
    return boosting.fit(
        prepared.filter("is_train"), FEATURES, "label", "weight", "customer_unique_id",
        boosting.Settings(rounds=rounds, seed=seed), shard_rows, most_shards,
    )


def predict(model: DataFrame, prepared: DataFrame) -> DataFrame:
    """customer_unique_id, is_train, label, repeat_probability, repeat_prediction."""
    return boosting.scored(prepared, model, FEATURES, "repeat_probability").select(
        "customer_unique_id", "is_train", "label", "repeat_probability",
        (F.col("repeat_probability") >= THRESHOLD).alias("repeat_prediction"),
    )


def model_rows(model: DataFrame, run_id: str, scored_at: datetime) -> DataFrame:
    """The model table: the nodes of all trees, from which predict() scores without training."""
    return fit_schema(
        model.withColumn("model_run_id", F.lit(run_id)).withColumn("scored_at", F.lit(scored_at)), "repeat_purchase_model"
    )


def score_rows(predicted: DataFrame, run_id: str, scored_at: datetime, version: str = MODEL_VERSION) -> DataFrame:
    """The scored table: every customer of the training table, trained on or not."""
    return fit_schema(
        predicted.withColumn("model_run_id", F.lit(run_id))
        .withColumn("scored_at", F.lit(scored_at))
        .withColumn("model_version", F.lit(version)),
        "customer_repeat_purchase_scores",
    )


def importance_rows(model: DataFrame, like: DataFrame, run_id: str, scored_at: datetime) -> DataFrame:
    values = boosting.importances(model, FEATURES)
    table = like.sparkSession.createDataFrame(list(zip(FEATURES, values)), "feature string, importance double")
    return fit_schema(
        table.withColumn("model_run_id", F.lit(run_id)).withColumn("scored_at", F.lit(scored_at)),
        "repeat_purchase_feature_importance",
    )


def report(predicted: DataFrame) -> DataFrame:
    """One row of metrics on the held-out part: ROC-AUC, average precision, the 2x2 matrix and its ratios."""
    held_out = predicted.filter(~F.col("is_train")).withColumn("will_repeat", F.col("label") == 1)
    counts = held_out.groupBy("will_repeat", "repeat_prediction").agg(F.count("*").alias("count"))
    auc = rank_auc(held_out, "repeat_probability", "will_repeat").select("roc_auc")
    precision = average_precision(held_out, "repeat_probability", "will_repeat").select("average_precision")
    return confusion_metrics(counts).crossJoin(F.broadcast(auc)).crossJoin(F.broadcast(precision))  # one row each
