from datetime import date, datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradewind.plans import forecast, propensity, segments, serving
from tradewind.schemas import SCORED
from tradewind.sources.sinks import fit_schema

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def centers(spark, rows):
    return spark.createDataFrame(
        [(i, float(r), float(f), float(m)) for i, (r, f, m) in enumerate(rows)],
        "cluster int, recency_days double, log_frequency double, log_monetary double",
    )


FIVE = [(5, 10, 1000), (50, 7, 700), (150, 4, 400), (300, 2, 200), (600, 1, 50)]


def test_segment_names_follow_ranks(spark):
    got = {r.cluster: r.segment_name for r in segments.label_segments(centers(spark, FIVE)).collect()}
    assert got == dict(enumerate(segments.NAMES))
    turned = {r.cluster: r.segment_name for r in segments.label_segments(centers(spark, FIVE[::-1])).collect()}
    assert turned[4] == "Champions" and turned[0] == "At Risk"
    six = {r.segment_name for r in segments.label_segments(centers(spark, FIVE + [(900, 1, 30)])).collect()}
    assert "Segment 6" in six and len(six) == 6


def shoppers(spark, n=200):
    r = np.random.default_rng(1)
    frame = pd.DataFrame({
        "customer_unique_id": [f"u{i}" for i in range(n)], "recency_days": r.integers(0, 400, n),
        "frequency": r.choice([1, 2, 3, 8], n, p=[0.9, 0.06, 0.03, 0.01]), "monetary": r.exponential(100, n),
    })
    return spark.createDataFrame(frame), frame


def test_rfm_scores_span_3_to_15(spark):
    df, frame = shoppers(spark)
    got = segments.rfm_scores(segments.rfm_base(df)).toPandas()
    assert got["rfm_score"].between(3, 15).all() and len(got) == 200
    recent = got.loc[got["recency_days"].idxmin()]
    assert recent.r_score == 5 and got.loc[got["recency_days"].idxmax()].r_score == 1


def test_customer_segments_table(spark):
    df, _ = shoppers(spark)
    table = segments.customer_segments(df, "run", NOW, k=3, restarts=2)
    assert table.schema.fieldNames() == SCORED["customer_segments"].fieldNames()
    rows = table.collect()
    assert len(rows) == 200 and {r.segment_name for r in rows} <= set(segments.NAMES[:3])
    summary = serving.segment_summary(table).collect()
    assert sum(r.customer_count for r in summary) == 200


def test_silhouette_sweep(spark):
    df, _ = shoppers(spark)
    rows = segments.silhouette_sweep(df, ks=[3, 4], restarts=2).collect()
    assert [r.k for r in rows] == [3, 4] and all(-1 <= r.silhouette <= 1 for r in rows)


def training(spark, n=400, planted=True):
    r = np.random.default_rng(2)
    frame = pd.DataFrame({
        "customer_unique_id": [f"u{i}" for i in range(n)], "frequency": r.integers(1, 6, n),
        "monetary": r.exponential(100, n), "avg_order_value": r.exponential(50, n),
        "tenure_days": r.integers(0, 400, n), "recency_at_T": r.integers(0, 200, n),
        "avg_review_score": [None if i % 4 == 0 else float(1 + i % 5) for i in range(n)],
        "reviewed_order_count": r.integers(0, 3, n), "max_installments_used": r.integers(1, 12, n),
        "used_credit_card": 1, "used_boleto": 0, "used_voucher": 0, "snapshot_date": date(2018, 1, 1),
        "outcome_end_date": date(2018, 6, 30),
    })
    frame["will_repeat"] = (frame["frequency"] >= 3) if planted else False
    return spark.createDataFrame(frame)


def test_split_is_stable_and_exact_per_class(spark):
    table = propensity.split(training(spark))
    for r in table.groupBy("will_repeat").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect():
        assert r.t == (8 * r.n + 5) // 10
    rows = {r.customer_unique_id: r.is_train for r in propensity.split(training(spark)).collect()}
    again = {r.customer_unique_id: r.is_train for r in propensity.split(training(spark).repartition(5)).collect()}
    assert rows == again


def test_features_in_order_without_null_and_with_the_train_median(spark):
    rows = propensity.split(training(spark))
    middle = propensity.review_median(rows)
    train = rows.filter("is_train").toPandas()
    assert middle.first().review_median == train["avg_review_score"].median()
    table = propensity.features(rows, middle)
    assert table.columns[3:] == propensity.FEATURES and len(propensity.FEATURES) == 12
    pdf = table.toPandas()
    assert not pdf.isna().any().any() and not set(table.columns) & propensity.BANNED
    filled = pdf[pdf["has_review"] == 0]
    assert len(filled) == 100 and (filled["avg_review_score"] == train["avg_review_score"].median()).all()


def test_guards(spark):
    prepared = propensity.prepare(training(spark, planted=False))
    with pytest.raises(ValueError, match="no variance"):
        propensity.fit(prepared, rounds=1)
    with pytest.raises(ValueError, match="leakage"):
        propensity.check_trainable(spark.createDataFrame([(1.0, 3)], "label double, recency_days int"))


def test_trees_find_a_planted_signal(spark):
    prepared = propensity.prepare(training(spark))
    model = propensity.fit(prepared, rounds=5)
    predicted = propensity.predict(model, prepared)
    scores = propensity.score_rows(predicted, "run", NOW)
    pdf = scores.toPandas()
    assert pdf["repeat_probability"].between(0, 1).all() and len(pdf) == 400
    assert ((pdf["repeat_probability"] >= 0.5) == pdf["repeat_prediction"]).all()
    report = propensity.report(predicted).first()
    assert report.roc_auc > 0.95 and report.average_precision > 0.9 and report.recall > 0.9
    importance = serving.feature_importance(propensity.importance_rows(model, prepared, "run", NOW)).collect()
    assert importance[0].feature == "frequency" and len(importance) == 12


def test_score_readers(spark):
    scores = spark.createDataFrame([("a", 0.9, True), ("b", 0.5, True), ("c", 0.1, False)],
                                   "customer_unique_id string, repeat_probability double, repeat_prediction boolean")
    people = spark.createDataFrame([("a", "SP", 2, 10.0, 5)], "customer_unique_id string, customer_state string, frequency int, monetary double, recency_days int")
    top = serving.high_propensity(scores, people, 2).collect()
    assert [(r.customer_unique_id, r.customer_state) for r in top] == [("a", "SP"), ("b", None)]
    sweep = {r.threshold: r.n_positive for r in serving.threshold_sweep(scores).collect()}
    assert len(sweep) == 17 and sweep[0.1] == 3 and sweep[0.5] == 2 and sweep[0.9] == 1
    none = serving.confusion_metrics(spark.createDataFrame([(False, False, 4)], "will_repeat boolean, repeat_prediction boolean, count bigint")).first()
    assert (none.tn, none.tp, none.accuracy, none.precision, none.recall, none.f1) == (4, 0, 1.0, 0.0, 0.0, 0.0)


def weekly(spark, **series):
    start = date(2017, 1, 1)
    rows = [(start + timedelta(weeks=i), name, int(v)) for name, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "week date, category string, order_count bigint")


def test_series_rules(spark):
    r = np.random.default_rng(0)
    df = weekly(spark, short=range(1, 12), just=range(1, 13), zeros=[0] * 20 + [3] * 12, fine=r.integers(5, 50, 40))
    rows = forecast.eligible_series(df).groupBy("category").agg(F.max("week_no"), F.max("n_weeks")).collect()
    assert {tuple(x) for x in rows} == {("just", 10, 10), ("fine", 38, 38)}
    split = forecast.holdout_split(forecast.eligible_series(df))
    held = {x.category: (x.h, x.n) for x in split.filter("is_test").groupBy("category").agg(F.max("holdout").alias("h"), F.count("*").alias("n")).collect()}
    assert held == {"just": (2, 2), "fine": (9, 9)}
    assert [x.category for x in forecast.top_categories(df, 2).collect()] == ["fine", "just"]


def test_gaps_can_be_filled(spark):
    df = spark.createDataFrame([(date(2018, 1, 7), "a", 3), (date(2018, 1, 28), "a", 4)], "week date, category string, order_count bigint")
    assert [r.order_count for r in forecast.fill_gaps(df).orderBy("week").collect()] == [3, 0, 0, 4]


def test_metrics(spark):
    rows = [("plain", 100.0, 110.0), ("plain", 200.0, 180.0), ("zero", 0.0, 5.0), ("double", 100.0, 200.0),
            ("some", 0.0, 7.0), ("some", 100.0, 110.0)]
    got = {r.category: r for r in forecast.forecast_metrics(spark.createDataFrame(rows, "category string, y_true double, y_pred double")).collect()}
    assert got["plain"].mape == 0.1 and got["plain"].mae == 15.0
    assert got["zero"].mape is None and got["double"].smape == 0.6667 and got["some"].mape == 0.1


@pytest.mark.parametrize("model", ["regression", "smoothing"])
def test_forecasts_lie_after_the_series(spark, model):
    r = np.random.default_rng(4)
    df = weekly(spark, a=r.integers(5, 50, 40), b=r.integers(5, 50, 30))
    split = forecast.holdout_split(forecast.eligible_series(df))
    rows = getattr(forecast, f"{model}_future")(split).orderBy("category", "week").collect()
    assert len(rows) == 24 and all(x.yhat >= 0 for x in rows)
    first = [x for x in rows if x.category == "a"][0]
    assert first.week == date(2017, 1, 1) + timedelta(weeks=38) and first.week.weekday() == 6
    assert (first.yhat_lower is None) == (model == "smoothing")
    held = getattr(forecast, f"{model}_holdout")(split).collect()
    assert len(held) == 9 + 7
    table = forecast.demand_forecasts(getattr(forecast, f"{model}_future")(split), "run", NOW)
    assert table.schema.fieldNames() == SCORED["demand_forecasts"].fieldNames()
    summary = {x.category: x for x in serving.forecast_summary(table).collect()}
    assert summary["a"].horizon_weeks == 12 and summary["a"].has_interval == (model == "regression")


def test_regression_matches_numpy(spark):
    y = np.random.default_rng(5).integers(5, 50, 80)
    split = forecast.holdout_split(forecast.eligible_series(weekly(spark, a=y)))
    got = [r.y_pred for r in forecast.regression_holdout(split, order=0).orderBy("week").collect()]
    x = np.arange(78) * 7 / 365.25
    slope, level = np.polyfit(x[:66], y[:66], 1)
    assert got == pytest.approx((level + slope * x[66:78]).tolist())


def test_smoothing_follows_a_season():
    season = np.array([10.0, 20, 30, 20])
    y = np.tile(season, 6) + np.arange(24) * 0.5
    _, path = forecast.smooth(y, 4, 0.2, 0.1, 0.3, 4)
    assert path == pytest.approx((season + (24 + np.arange(4)) * 0.5).tolist(), abs=1.0)
    assert forecast.season_length(8) == 4 and forecast.season_length(7) == 0 and forecast.season_length(300) == 52


def test_declared_schema_is_enforced(spark):
    with pytest.raises(ValueError, match="missing"):
        fit_schema(spark.range(1), "demand_forecasts")
