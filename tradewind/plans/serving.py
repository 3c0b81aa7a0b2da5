"""What a dashboard reads: small results, computed where the data is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import DELIVERED, month_start, ratio, week_start
from tradewind.operators.skew import lookup_join


def _delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == DELIVERED)


def kpis(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Total revenue, order count, average order value; share of inactive customers in percent."""
    paid = F.col("total_payment_value")
    sales = _delivered(orders).agg(
        F.round(F.sum(paid), 2).alias("total_revenue"),
        F.count_distinct("order_id").alias("order_count"),
        F.round(ratio(F.sum(paid), F.count(paid)), 2).alias("aov"),
    )
    inactive = customers.agg(
        F.round(F.avg(F.col("is_inactive").cast("int")) * 100, 1).alias("inactive_pct")
    )
    return sales.crossJoin(F.broadcast(inactive))  # one row each


def revenue_by_month(orders: DataFrame) -> DataFrame:
    return (
        _delivered(orders)
        .filter(F.col("order_month").isNotNull())
        .groupBy("order_month")
        .agg(
            F.round(F.sum("total_payment_value"), 2).alias("revenue"),
            F.count_distinct("order_id").alias("order_count"),
        )
        .orderBy("order_month")
    )


def orders_by_state(orders: DataFrame, n: int | None = None) -> DataFrame:
    """Orders and revenue per state, most orders first; all states or the first n."""
    states = (
        _delivered(orders)
        .filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.round(F.sum("total_payment_value"), 2).alias("revenue"),
        )
        .orderBy(F.col("order_count").desc(), "customer_state")
    )
    return states if n is None else states.limit(n)


def cohort_retention(cohorts: DataFrame) -> DataFrame:
    """Active customers over those active in month 0; a cohort without a month 0 has no row."""
    size = cohorts.filter("months_since_first = 0").select(
        "cohort_month", F.col("active_customers").alias("cohort_size")
    )
    return (
        cohorts.join(size, "cohort_month")
        .select(
            "cohort_month", "months_since_first", "active_customers",
            ratio(F.col("active_customers"), F.col("cohort_size")).alias("retention_rate"),
        )
        .orderBy("cohort_month", "months_since_first")
    )


def retention_of_cohort(cohorts: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Active customers over everybody whose first order fell in the cohort month."""
    size = (
        orders.join(customers, "customer_id")
        .groupBy("customer_unique_id")
        .agg(month_start(F.min("order_purchase_timestamp")).alias("cohort_month"))
        .groupBy("cohort_month")
        .agg(F.count("customer_unique_id").alias("cohort_size"))
    )
    return cohorts.join(size, "cohort_month").select(
        "cohort_month", "months_since_first", "active_customers", "cohort_size",
        ratio(F.col("active_customers"), F.col("cohort_size")).alias("retention_rate"),
    )


def cohort_pivot(retention: DataFrame, months: int | None = None) -> DataFrame:
    """Cohort rows, one column m<offset> for every month offset in the data (a number a month on the driver).

    With months, the columns are m0 to m<months - 1> whatever the data; an offset beyond them is an error.
    """
    offsets = [r[0] for r in retention.select("months_since_first").distinct().orderBy("months_since_first").collect()]
    if months is not None:
        if offsets and offsets[-1] >= months:
            raise ValueError(f"month offset {offsets[-1]} is beyond the {months} columns asked for")
        offsets = range(months)
    return (
        retention.withColumn("cohort", F.date_format("cohort_month", "yyyy-MM"))
        .groupBy("cohort")
        .agg(
            *[F.max(F.when(F.col("months_since_first") == m, F.col("retention_rate"))).alias(f"m{m}") for m in offsets]
        )
        .orderBy("cohort")
    )


def segment_summary(segments: DataFrame) -> DataFrame:
    return (
        segments.groupBy("segment_name")
        .agg(
            F.count("*").alias("customer_count"),
            F.round(ratio(F.sum("monetary"), F.count("monetary")), 2).alias("avg_monetary"),
            F.round(F.avg("recency_days"), 0).alias("avg_recency_days"),
            F.round(F.avg("rfm_score"), 2).alias("avg_rfm_score"),
        )
        .orderBy(F.col("avg_monetary").desc())
    )


def positive_spend(customers: DataFrame) -> DataFrame:
    """Spend of every customer who spent something; fed to percentiles and histograms."""
    return customers.filter(F.col("monetary") > 0).select("customer_unique_id", "monetary")


def ranked_customers(customers: DataFrame, n: int = 20, ascending: bool = False) -> DataFrame:
    """The n customers who spent most (or least); ties by id. A bounded sort, never a full one."""
    spend = F.col("monetary")
    order = spend.asc_nulls_first() if ascending else spend.desc_nulls_last()
    return (
        customers.orderBy(order, "customer_unique_id")
        .limit(n)
        .select(
            "customer_unique_id", "customer_state",
            F.round("monetary", 2).alias("total_spent"),
            F.col("frequency").alias("order_count"),
            F.round("avg_order_value", 2).alias("avg_order_value"),
            "recency_days",
        )
    )


def repeat_scores(scores: DataFrame) -> DataFrame:
    return scores.select("repeat_probability", "repeat_prediction")


def high_propensity(scores: DataFrame, customers: DataFrame, limit: int = 100) -> DataFrame:
    """The most likely returners. Limited before the join: it is a left join on a unique key."""
    top = (
        scores.orderBy(F.col("repeat_probability").desc(), "customer_unique_id")
        .limit(limit)
        .select("customer_unique_id", "repeat_probability", "repeat_prediction")
    )
    details = customers.select("customer_unique_id", "customer_state", "frequency", "monetary", "recency_days")
    # `limit` rows: a checked size. The details of nobody else leave their partition.
    wanted = details.join(F.broadcast(top.select("customer_unique_id")), "customer_unique_id", "left_semi")
    return (
        top.join(wanted, "customer_unique_id", "left")
        .select(
            "customer_unique_id",
            F.round("repeat_probability", 4).alias("repeat_probability"),
            "repeat_prediction", "customer_state", "frequency",
            F.round("monetary", 2).alias("total_spent"),
            "recency_days",
        )
        .orderBy(F.col("repeat_probability").desc(), "customer_unique_id")
    )


def confusion_counts(scores: DataFrame, training: DataFrame) -> DataFrame:
    return (
        scores.join(training.select("customer_unique_id", "will_repeat"), "customer_unique_id")
        .groupBy("will_repeat", "repeat_prediction")
        .agg(F.count("*").alias("count"))
        .orderBy("will_repeat", "repeat_prediction")
    )


def feature_importance(importances: DataFrame) -> DataFrame:
    return importances.select("feature", F.round("importance", 6).alias("importance")).orderBy(
        F.col("importance").desc(), "feature"
    )


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """The 2x2 matrix and accuracy, precision, recall, F1; absent cells count 0, undefined ratios are 0."""

    def cell(actual: bool, predicted: bool):
        hit = (F.col("will_repeat") == actual) & (F.col("repeat_prediction") == predicted)
        return F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0))

    def or_zero(part, whole):
        return F.coalesce(ratio(part, whole), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.agg(
            cell(False, False).alias("tn"), cell(False, True).alias("fp"),
            cell(True, False).alias("fn"), cell(True, True).alias("tp"),
        )
        .withColumn("accuracy", or_zero(F.col("tn") + tp, F.col("tn") + fp + fn + tp))
        .withColumn("precision", or_zero(tp, tp + fp))
        .withColumn("recall", or_zero(tp, tp + fn))
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(F.lit(2) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                F.lit(0.0),
            ),
        )
    )


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """Customers at or above each decision threshold 0.10, 0.15 .. 0.90, all in one pass."""
    steps = [round(0.10 + 0.05 * i, 2) for i in range(17)]
    total = F.count("*")
    hits = F.array(*[F.struct(F.lit(t).alias("threshold"),
                              F.count(F.when(F.col("repeat_probability") >= t, 1)).alias("n_positive")) for t in steps])
    return (
        scores.agg(hits.alias("hits"), total.alias("n_scored"))
        .select(F.explode("hits").alias("s"), "n_scored")
        .select(
            "s.threshold", "s.n_positive", "n_scored",
            (ratio(F.col("s.n_positive"), F.col("n_scored")) * 100).alias("pct_positive"),
        )
        .orderBy("threshold")
    )


def weekly_demand(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct delivered orders per category and Sunday week.

    Items shrink to distinct (order, product) and then (order, category) pairs before they are counted.
    """
    delivered = _delivered(orders).select("order_id", week_start(F.col("order_purchase_timestamp")).alias("week"))
    named = products.filter(F.col("product_category_name_english").isNotNull()).select(
        "product_id", F.col("product_category_name_english").alias("category")
    )
    pairs = lookup_join(items.select("order_id", "product_id").distinct(), named, "product_id", "inner")
    return (
        pairs.select("order_id", "category").distinct()
        .join(delivered, "order_id")
        .groupBy("week", "category")
        .agg(F.count_distinct("order_id").alias("order_count"))
    )


def forecasts(table: DataFrame) -> DataFrame:
    return table.select("category", "week", "yhat", "yhat_lower", "yhat_upper", "model").orderBy("category", "week")


def forecast_summary(table: DataFrame) -> DataFrame:
    """Per category: weeks ahead, model, mean forecast, whether it carries an interval."""
    return (
        table.groupBy("category")
        .agg(
            F.count("*").alias("horizon_weeks"),
            F.min("model").alias("model"),
            F.avg("yhat").alias("avg_weekly_orders"),
            (F.max(F.col("yhat_lower").isNotNull()) & F.max(F.col("yhat_upper").isNotNull())).alias("has_interval"),
        )
        .orderBy("category")
    )


def forecast_overlay(actuals: DataFrame, table: DataFrame) -> DataFrame:
    """History and forecast of each category as one series of rows."""
    history = actuals.select("category", "week", F.col("order_count").cast("double").alias("value"), F.lit("actual").alias("kind"))
    ahead = table.select(
        "category", "week", F.col("yhat").alias("value"), "yhat_lower", "yhat_upper", F.lit("forecast").alias("kind")
    )
    return history.unionByName(ahead, allowMissingColumns=True)
