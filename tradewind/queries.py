"""Every query by name: (spark, directory of the star-schema tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.scalars import doubles, surrogate_key
from tradewind.operators.histogram import histogram
from tradewind.operators.quantiles import quantiles
from tradewind.operators.ranking import average_precision, rank_auc
from tradewind.plans import experiments, explore, facts, forecast, propensity, quality, segments, serving
from tradewind.plans.models import INTERMEDIATE, MARTS, STAGING, Models
from tradewind.schemas import BRONZE
from tradewind.session import tune
from tradewind.sources import csv_files, scratch, star
from tradewind.streaming import orders as stream

Query = Callable[[SparkSession, str], DataFrame]

RUN_ID = "registered-query"
SCORED_AT = datetime(2024, 1, 1, tzinfo=timezone.utc)
REPLAY_START = datetime(2024, 1, 1, tzinfo=timezone.utc)


#: Months that the star schema's orders span, so that the pivot's columns do not depend on the rows.
PIVOT_MONTHS = 84

_GRAPHS: dict = {}


def models(spark: SparkSession, directory: str, **settings) -> Models:
    """The lazy model graph over a directory; its DataFrames are plans, so queries of a session share them."""
    key = (spark.sparkContext.applicationId, id(spark), directory, *sorted(settings.items()))
    if key not in _GRAPHS:
        _GRAPHS[key] = Models(star.bronze(tune(spark), directory), **settings)
    return _GRAPHS[key]


def _over_models(build: Callable[[Models], DataFrame], **settings) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return doubles(build(models(spark, directory, **settings)))

    return run


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _tables() -> dict[str, Query]:
    queries = {}
    for name in STAGING + INTERMEDIATE + MARTS:
        queries[name] = _over_models(lambda m, name=name: getattr(m, name))
    queries["repeat_training"] = queries.pop("repeat_purchase_training")
    queries["repeat_training_dated"] = _over_models(
        lambda m: m.repeat_purchase_training, snapshot_date="1999-06-30", horizon_days=90
    )
    return queries


def _serving() -> dict[str, Query]:
    spec = {
        "kpis": lambda m: serving.kpis(m.fct_orders, m.dim_customers),
        "revenue_by_month": lambda m: serving.revenue_by_month(m.fct_orders),
        "orders_by_state": lambda m: serving.orders_by_state(m.fct_orders),
        "orders_by_state_top": lambda m: serving.orders_by_state(m.fct_orders, 15),
        "order_item_keys": lambda m: m.stg_order_items.select(
            "order_id", "order_item_id", "product_id", "seller_id",
            surrogate_key(*[F.col(c) for c in ("order_id", "order_item_id", "product_id", "seller_id")]).alias("item_key"),
        ),
        "positive_spend": lambda m: serving.positive_spend(m.dim_customers),
        "cohort_retention": lambda m: serving.cohort_retention(m.customer_cohorts),
        "retention_of_cohort": lambda m: serving.retention_of_cohort(
            m.customer_cohorts, m.stg_orders, m.stg_customers
        ),
        "cohort_pivot": lambda m: serving.cohort_pivot(
            scratch.written(serving.cohort_retention(m.customer_cohorts), "retention"), PIVOT_MONTHS
        ),
        "top_customers": lambda m: serving.ranked_customers(m.dim_customers),
        "bottom_customers": lambda m: serving.ranked_customers(m.dim_customers, ascending=True),
        "ltv_percentiles": lambda m: _rounded(
            quantiles(serving.positive_spend(m.dim_customers), "monetary", [0.25, 0.5, 0.75, 0.9]), 4, "quantile"
        ),
        "ltv_histogram": lambda m: histogram(serving.positive_spend(m.dim_customers), "monetary", 60, cap=2_000_000.0),
        "weekly_demand": lambda m: serving.weekly_demand(m.stg_order_items, m.fct_orders, m.dim_products),
    }
    return {name: _over_models(build) for name, build in spec.items()}


def _explore() -> dict[str, Query]:
    spec = {
        "table_counts": lambda m: explore.table_counts(
            orders=m.fct_orders, customers=m.dim_customers, order_items=m.fct_order_items, cohorts=m.customer_cohorts
        ),
        "monthly_orders_all": lambda m: explore.monthly_orders_all(m.fct_orders),
        "data_span": lambda m: explore.data_span(m.fct_orders),
        "last_order_histogram": lambda m: explore.last_order_histogram(m.dim_customers),
        "frequency_distribution": lambda m: explore.frequency_distribution(m.dim_customers),
        "revenue_by_state_top": lambda m: explore.revenue_by_state_top(m.fct_orders),
        "review_distribution": lambda m: explore.review_distribution(m.fct_orders),
        "delivery_sla": lambda m: explore.delivery_sla(m.fct_orders),
        "delivery_days_histogram": lambda m: explore.delivery_days_histogram(m.fct_orders),
        "payment_mix": lambda m: explore.payment_mix(m.dim_customers),
        "category_revenue_top": lambda m: explore.category_revenue_top(m.fct_order_items),
        "rfm_histograms": lambda m: _rounded(explore.rfm_histograms(m.dim_customers), 6, "bin_start", "bin_end"),
        "rfm_correlation": lambda m: _rounded(explore.rfm_correlation(m.dim_customers), 6, "correlation"),
    }
    return {name: _over_models(build) for name, build in spec.items()}


def _quality() -> dict[str, Query]:
    def table_of(m: Models):
        def table(name: str) -> DataFrame:
            return getattr(m, name) if hasattr(m, name) else getattr(m.bronze, name)

        return table

    def built(m: Models, *names: str):
        """table_of with the named models written once, as in a build, because many checks read them."""
        own = Models(m.bronze)
        for name in names:
            own.store(name, scratch.written(getattr(own, name), name))
        return table_of(own)

    spec = {
        "dq_not_null": lambda m: quality.not_null_checks(
            built(m, "stg_order_payments", "int_orders_enriched", "int_customer_orders", "fct_orders")
        ),
        "dq_unique": lambda m: quality.unique_checks(built(m, "int_orders_enriched", "fct_orders")),
        "dq_accepted_values": lambda m: quality.accepted_values_checks(table_of(m)),
        "dq_relationships": lambda m: quality.relationship_checks(built(m, "fct_orders")),
        "dq_payment_positive": lambda m: quality.payment_positive(m.stg_order_payments),
        "dq_recency": lambda m: quality.recency_non_negative(m.repeat_purchase_training),
        "dq_label_classes": lambda m: quality.both_label_classes(m.repeat_purchase_training),
        "dq_tenure": lambda m: quality.tenure_not_below_recency(m.repeat_purchase_training),
        "dq_freshness": lambda m: quality.freshness(
            m.bronze.orders, "orders", "order_purchase_timestamp", datetime(2001, 8, 3, 2, tzinfo=timezone.utc)
        ),
    }
    return {name: _over_models(build) for name, build in spec.items()}


def _experiments() -> dict[str, Query]:
    by = ["experiment"]

    def over(which: int, build: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, directory: build(star.experiments(tune(spark), directory)[which])

    arms = {
        "ab_arms_proportion": lambda m: experiments.arms_proportion(m.fct_orders),
        "ab_arms_continuous": lambda m: experiments.arms_continuous(m.fct_orders),
        "ab_arm_summary": lambda m: experiments.arm_summary(experiments.arms_proportion(m.fct_orders))
        .withColumn("case", F.lit("proportion"))
        .unionByName(
            experiments.arm_summary(experiments.arms_continuous(m.fct_orders)).withColumn("case", F.lit("continuous"))
        ),
    }
    sizes = "recommended_sample_size"
    return {
        **{name: _over_models(build) for name, build in arms.items()},
        "ab_proportion": over(
            1,
            lambda e: _rounded(
                experiments.proportion_test(e, by).select(
                    *by, "n_control", "n_variant", "statistic", "p_value", "ci_low", "ci_high"
                ),
                6, "statistic", "p_value", "ci_low", "ci_high",
            ),
        ),
        "ab_welch": over(
            0,
            lambda e: _rounded(
                experiments.welch_test(e, by).select(
                    *by, "n_control", "n_variant", "statistic", "df", "p_value", "ci_low", "ci_high"
                ),
                6, "statistic", "df", "p_value", "ci_low", "ci_high",
            ),
        ),
        "ab_mannwhitney": over(
            0, lambda e: _rounded(experiments.mann_whitney(experiments.arm_counts(e, by), by), 6, "p_value")
        ),
        "ab_normality": over(0, lambda e: experiments.normality(e, by)),
        "ab_normality_check": over(0, lambda e: facts.normality_facts(experiments.normality(e, by), by)),
        "ab_bootstrap": over(
            0, lambda e: experiments.bootstrap_interval(experiments.arm_counts(e, by), "value", by, 0.05)
        ),
        "ab_bootstrap_check": over(0, lambda e: facts.bootstrap_facts(e, by)),
        "ab_sample_size": lambda spark, directory: over(
            0, lambda e: experiments.sample_sizes(e, by, "continuous").withColumn("metric", F.lit("continuous"))
        )(spark, directory).unionByName(
            over(
                1,
                lambda e: experiments.sample_sizes(e, by, "proportion")
                .withColumn("experiment", F.col("experiment").cast("string"))
                .withColumn("metric", F.lit("proportion")),
            )(spark, directory)
        ).select("metric", *by, "n_control", "n_variant", sizes),
        "ab_test": over(0, lambda e: experiments.ab_test(e, by, "continuous")),
        "ab_test_check": over(0, lambda e: facts.test_facts(experiments.ab_test(e, by, "continuous"), by)),
        "ab_test_proportion": over(
            1,
            lambda e: _rounded(
                experiments.ab_test(e, by, "proportion"), 6, "statistic", "p_value", "ci_low", "ci_high"
            ),
        ),
    }


def _banded(m: Models) -> DataFrame:
    """Customers with RFM scores and five clusters cut from the score: a clustering SQL can repeat."""
    scored = segments.rfm_scores(segments.rfm_base(m.dim_customers))
    band = F.least(F.lit(4), F.expr("cast(rfm_score - 3 as int) div 3")).cast("int")
    return segments.with_features(scored).withColumn("cluster", band)


def _band_centers(banded: DataFrame) -> DataFrame:
    means = [F.round(F.avg(c), 6).alias(c) for c in segments.FEATURES]
    return banded.groupBy("cluster").agg(*means)


def _banded_segments(m: Models) -> DataFrame:
    banded = scratch.written(_banded(m), "banded")
    return segments.segment_rows(banded, segments.label_segments(_band_centers(banded)), RUN_ID, SCORED_AT)


def _segments() -> dict[str, Query]:
    spec = {
        "rfm_quintiles": lambda m: segments.rfm_scores(segments.rfm_base(m.dim_customers)).select(
            "customer_unique_id", "r_score", "f_score", "m_score"
        ),
        "rfm_score": lambda m: segments.rfm_scores(segments.rfm_base(m.dim_customers)).select(
            "customer_unique_id", "rfm_score"
        ),
        "label_segments": lambda m: segments.label_segments(_band_centers(_banded(m))),
        "segment_summary": lambda m: serving.segment_summary(_banded_segments(m)),
        "silhouette_sweep": lambda m: segments.silhouette_sweep(m.dim_customers),
        "silhouette_sweep_check": lambda m: facts.sweep_facts(segments.silhouette_sweep(m.dim_customers)),
        "customer_segments": lambda m: segments.customer_segments(m.dim_customers, RUN_ID, SCORED_AT),
        "customer_segments_check": lambda m: facts.cluster_facts(m.dim_customers),
    }
    return {name: _over_models(build) for name, build in spec.items()}


def _simple_scores(training: DataFrame) -> DataFrame:
    """A score SQL can repeat digit by digit, for the readers and metrics that take any scores."""
    f, r = F.col("frequency").cast("double"), F.col("recency_at_T").cast("double")
    return training.select(
        "customer_unique_id", "will_repeat", (f / (f + 1.0 + r / 60.0)).alias("repeat_probability")
    ).withColumn("repeat_prediction", F.col("repeat_probability") >= propensity.THRESHOLD)


_MODELS: dict = {}


def _trained(spark: SparkSession, directory: str):
    """(prepared features, model): one training job feeds three tables, until the scratch tables go."""
    key = (spark.sparkContext.applicationId, directory, scratch.generation(spark))
    if key not in _MODELS:
        _MODELS.clear()
        prepared = propensity.prepare(models(spark, directory).repeat_purchase_training)
        _MODELS[key] = prepared, propensity.fit(prepared)
    return _MODELS[key]


def _propensity() -> dict[str, Query]:
    def scores(m: Models) -> DataFrame:
        return _simple_scores(m.repeat_purchase_training)

    def counts(m: Models) -> DataFrame:
        return serving.confusion_counts(scores(m).drop("will_repeat"), m.repeat_purchase_training)

    def split(m: Models) -> DataFrame:
        return propensity.split(m.repeat_purchase_training)

    def features(m: Models) -> DataFrame:
        stored = scratch.written(split(m), "training")
        return propensity.features(stored, propensity.review_median(stored))

    def predicted(spark: SparkSession, directory: str) -> DataFrame:
        prepared, model = _trained(spark, directory)
        return propensity.predict(model, prepared)

    def scored(spark: SparkSession, directory: str) -> DataFrame:
        return propensity.score_rows(predicted(spark, directory), RUN_ID, SCORED_AT)

    def importance(spark: SparkSession, directory: str) -> DataFrame:
        prepared, model = _trained(spark, directory)
        return serving.feature_importance(propensity.importance_rows(model, prepared, RUN_ID, SCORED_AT))

    spec = {
        "propensity_split": lambda m: split(m).select("customer_unique_id", "will_repeat", "is_train"),
        "propensity_features": features,
        "propensity_weights": lambda m: propensity.class_weights(split(m)),
        "score_histogram": lambda m: histogram(scores(m), "repeat_probability", 50),
        "threshold_sweep": lambda m: serving.threshold_sweep(scores(m)),
        "high_propensity": lambda m: serving.high_propensity(scores(m), m.dim_customers),
        "confusion_counts": counts,
        "confusion_metrics": lambda m: serving.confusion_metrics(counts(m)),
        "roc_auc": lambda m: _rounded(rank_auc(scores(m), "repeat_probability", "will_repeat"), 9, "roc_auc"),
        "average_precision": lambda m: _rounded(
            average_precision(scores(m), "repeat_probability", "will_repeat"), 9, "average_precision"
        ),
    }
    return {
        **{name: _over_models(build) for name, build in spec.items()},
        "repeat_scores": scored,
        "repeat_scores_check": lambda spark, directory: facts.score_facts(scored(spark, directory)),
        "propensity_report": lambda spark, directory: propensity.report(
            scratch.written(predicted(spark, directory), "predicted")
        ),
        "propensity_report_check": lambda spark, directory: facts.report_facts(predicted(spark, directory)),
        "propensity_importance": importance,
        "propensity_importance_check": lambda spark, directory: facts.importance_facts(importance(spark, directory)),
        "repeat_score_values": lambda spark, directory: serving.repeat_scores(
            _simple_scores(models(spark, directory).repeat_purchase_training)
        ),
    }


def _forecast() -> dict[str, Query]:
    def weekly(m: Models) -> DataFrame:
        table = serving.weekly_demand(m.stg_order_items, m.fct_orders, m.dim_products)
        return scratch.written(table, "weekly")  # small, read several times

    def held_out(m: Models) -> DataFrame:
        return forecast.holdout_split(forecast.eligible_series(forecast.only_top(weekly(m))))

    def trend(m: Models) -> DataFrame:
        return forecast.regression_future(held_out(m), order=0)

    def overlay(m: Models) -> DataFrame:
        actuals = weekly(m)
        split = forecast.holdout_split(forecast.eligible_series(forecast.only_top(actuals)))
        return serving.forecast_overlay(actuals, forecast.regression_future(split, order=0))

    def seasonal_metrics(m: Models) -> DataFrame:
        return forecast.forecast_metrics(forecast.regression_holdout(held_out(m)))

    def smoothing_metrics(m: Models) -> DataFrame:
        return forecast.forecast_metrics(forecast.smoothing_holdout(held_out(m)))

    bounds = ["yhat", "yhat_lower", "yhat_upper"]
    spec = {
        "top_categories": lambda m: forecast.top_categories(weekly(m)),
        "eligible_series": lambda m: forecast.eligible_series(weekly(m)),
        "eligible_series_filled": lambda m: forecast.eligible_series(weekly(m), gaps=True),
        "holdout_split": held_out,
        "demand_trend": lambda m: _rounded(trend(m), 4, *bounds),
        "forecast_metrics": lambda m: forecast.forecast_metrics(forecast.regression_holdout(held_out(m), order=0)),
        "forecast_summary": lambda m: _rounded(serving.forecast_summary(trend(m)), 4, "avg_weekly_orders"),
        "forecast_overlay": lambda m: _rounded(overlay(m), 4, "value", "yhat_lower", "yhat_upper"),
        "forecasts": lambda m: _rounded(
            serving.forecasts(forecast.demand_forecasts(trend(m), RUN_ID, SCORED_AT)), 4, *bounds
        ),
        "demand_forecast": lambda m: forecast.demand_forecasts(
            forecast.regression_future(held_out(m)), RUN_ID, SCORED_AT
        ),
        "demand_forecast_check": lambda m: facts.regression_facts(held_out(m)),
        "demand_forecast_hw": lambda m: forecast.demand_forecasts(
            forecast.smoothing_future(held_out(m)), RUN_ID, SCORED_AT
        ),
        "demand_forecast_hw_check": lambda m: facts.smoothing_facts(held_out(m)),
        "forecast_metrics_seasonal": seasonal_metrics,
        "forecast_metrics_seasonal_check": lambda m: facts.metric_facts(seasonal_metrics(m)),
        "forecast_metrics_hw": smoothing_metrics,
        "forecast_metrics_hw_check": lambda m: facts.metric_facts(smoothing_metrics(m)),
    }
    return {name: _over_models(build) for name, build in spec.items()}


EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _events_json(spark: SparkSession, directory: str) -> DataFrame:
    return stream.to_events(star.read_table(tune(spark), directory, "events"), "event_id")


def _stream_orders(spark: SparkSession, directory: str) -> DataFrame:
    """The event table published as JSON text files, then loaded by the streaming job."""
    messages, target, dead, checkpoint = (
        scratch.new_path(tune(spark), n) for n in ("messages", "events", "rejected", "progress")
    )
    _events_json(spark, directory).select("value").write.text(messages)
    schema = spark.createDataFrame([], EVENT).schema
    stream.load(stream.text_folder(spark, messages), schema, target, dead, checkpoint)
    loaded = spark.read.schema(schema).parquet(target)
    return loaded.withColumn("k", F.get_json_object("props", "$.k").cast("int")).drop("props")


def _replay(spark: SparkSession, directory: str) -> DataFrame:
    orders = star.bronze(tune(spark), directory).orders.select("order_id", "order_status", "order_purchase_timestamp")
    return stream.replayed(orders, "order_purchase_timestamp", REPLAY_START)


def _ingest_csv(spark: SparkSession, directory: str) -> DataFrame:
    """The reviews as quoted multi-line CSV files, read back through the landing job's reader."""
    reviews = star.bronze(tune(spark), directory).order_reviews
    text = F.concat(F.lit('first line\n"quoted", line of '), F.col("review_id"))
    path = scratch.new_path(spark, "reviews-csv")
    (
        reviews.withColumn("review_comment_message", text)
        .withColumn("review_comment_title", F.lit(None).cast("string"))
        .select(
            "review_id", F.col("order_id").cast("string").alias("order_id"), "review_score", "review_comment_title",
            "review_comment_message",
            *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("review_creation_date", "review_answer_timestamp")],
        )
        .write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    )
    return csv_files.good_rows(csv_files.read_csv(spark, path, "order_reviews"))


def _ingest_csv_tables(spark: SparkSession, directory: str) -> DataFrame:
    """All nine tables as CSV files, landed by the landing job: table_name, rows landed, rows rejected."""
    shop = star.bronze(tune(spark), directory)
    source, target = scratch.new_path(spark, "csv"), scratch.new_path(spark, "landed")
    paths = {}
    for name, table in shop.items():
        kinds = dict(table.dtypes)

        def text(c: str, kinds=kinds):
            if c not in kinds:  # the star schema has no such column
                return F.lit(None).cast("string").alias(c)
            stamp = kinds[c].startswith("timestamp")
            return (F.date_format(c, "yyyy-MM-dd HH:mm:ss") if stamp else F.col(c).cast("string")).alias(c)

        columns = [text(c) for c in BRONZE[name].fieldNames()]
        paths[name] = f"{source}/{name}"
        table.select(*columns).write.option("header", True).option("quote", '"').option("escape", '"').csv(paths[name])
    csv_files.land(spark, paths, target)
    return csv_files.landed_counts(spark, target)


def queries() -> dict[str, Query]:
    return {
        **_tables(),
        **_serving(),
        **_explore(),
        **_quality(),
        **_experiments(),
        **_segments(),
        **_propensity(),
        **_forecast(),
        "events_json": _events_json,
        "stream_orders": _stream_orders,
        "replay_timestamps": _replay,
        "ingest_csv": _ingest_csv,
        "ingest_csv_tables": _ingest_csv_tables,
    }
