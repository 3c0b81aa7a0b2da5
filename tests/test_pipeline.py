import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.shop import bronze
from tradewind.plans import quality
from tradewind.plans.build import build
from tradewind.plans.models import Models
from tradewind.schemas import BRONZE, ORDER_EVENT
from tradewind.sources import csv_files, scratch, sinks
from tradewind.streaming import orders as stream


def failing(df):
    return {(r.check, r.table, r.column): (r.severity, r.failing_rows) for r in df.collect() if r.failing_rows}


def test_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), (None, "z"), (None, "z")], "k string, v string")
    assert failing(quality.not_null(df, "t", ["k", "v"], {("t", "v")})) == {
        ("not_null", "t", "k"): ("error", 2), ("not_null", "t", "v"): ("warn", 1)}
    assert failing(quality.unique(df, "t", "k")) == {("unique", "t", "k"): ("error", 1)}
    assert failing(quality.accepted_values(df, "t", "v", ["x", "y"])) == {("accepted_values", "t", "v"): ("error", 2)}
    parent = spark.createDataFrame([("a",)], "k string")
    assert failing(quality.relationships(df, "t", "k", parent, "warn")) == {("relationships", "t", "k"): ("warn", 1)}
    assert failing(quality.relationships(parent, "t", "k", df)) == {}


def test_checks_of_the_shop(spark):
    m = Models(bronze(spark))
    assert failing(quality.payment_positive(m.stg_order_payments)) == {
        ("payment_value_positive", "stg_order_payments", "total_payment_value"): ("warn", 1)}
    assert failing(quality.relationships(m.fct_order_items, "fct_order_items", "order_id", m.fct_orders, "warn")) == {
        ("relationships", "fct_order_items", "order_id"): ("warn", 1)}
    training = Models(bronze(spark), snapshot_date="2018-02-15", horizon_days=30).repeat_purchase_training
    assert failing(quality.training_checks(training)) == {}
    one_class = training.withColumn("will_repeat", F.lit(False)).withColumn("recency_at_T", F.lit(-1))
    assert failing(quality.training_checks(one_class)) == {
        ("both_label_classes", "repeat_purchase_training", "will_repeat"): ("error", 1),
        ("recency_non_negative", "repeat_purchase_training", "recency_at_T"): ("error", 2)}


@pytest.mark.parametrize("hours,severity", [(24, "pass"), (26, "warn"), (50, "error")])
def test_freshness(spark, hours, severity):
    newest = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(newest,)], "ts timestamp")
    assert quality.freshness(df, "t", "ts", newest + timedelta(hours=hours)).first().severity == severity
    assert quality.freshness(df.limit(0), "t", "ts", newest).first().severity == "error"


def test_build_writes_checked_gold_tables(spark):
    gold = build(spark, bronze(spark), snapshot_date="2018-02-15", horizon_days=30)
    assert gold.fct_orders.count() == 5 and gold.stg_orders.count() == 6 and gold.int_customer_orders.count() == 3
    assert sinks.table_exists(spark, "gold", "seller_performance")
    assert sinks.read_if_exists(spark, "gold", "customer_segments") is None
    again = build(spark, bronze(spark), snapshot_date="2018-02-15", horizon_days=30)
    assert again.fct_orders.count() == 5


def test_model_jobs_write_their_gold_tables(spark):
    from tests.test_learning import training, weekly
    from tradewind.plans import jobs, serving

    gold = build(spark, bronze(spark), snapshot_date="2018-02-15", horizon_days=30)
    jobs.write_segments(gold, run_id="r", k=2, restarts=1)
    summary = serving.segment_summary(gold.customer_segments).collect()
    assert sum(r.customer_count for r in summary) == gold.dim_customers.count()

    class Trained:
        repeat_purchase_training = training(spark)

    jobs.write_repeat_scores(Trained, run_id="r", rounds=3)
    before = sorted(map(tuple, serving.repeat_scores(gold.customer_repeat_purchase_scores).collect()))
    Trained.spark = spark
    jobs.rescore_repeat(Trained, run_id="s")
    assert sorted(map(tuple, serving.repeat_scores(gold.customer_repeat_purchase_scores).collect())) == before
    assert serving.repeat_scores(gold.customer_repeat_purchase_scores).count() == Trained.repeat_purchase_training.count()
    assert serving.feature_importance(gold.repeat_purchase_feature_importance).count() == 12
    jobs.write_forecasts(gold, run_id="r")  # the shop's series are too short: a table without rows
    assert serving.forecasts(gold.demand_forecasts).count() == 0
    assert not [t.name for t in spark.catalog.listTables("gold") if t.name.endswith("__staged")]
    for table in ("customer_segments", "customer_repeat_purchase_scores", "repeat_purchase_feature_importance", "repeat_purchase_model", "demand_forecasts"):
        spark.sql(f"DROP TABLE gold.{table}")


def test_stale_orders_stop_a_build_that_asks(spark):
    with pytest.raises(quality.QualityError, match="freshness"):
        build(spark, bronze(spark), snapshot_date="2018-02-15", horizon_days=30, now=datetime(2024, 1, 1, tzinfo=timezone.utc))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_a_quoted_nan_is_text(spark):
    messages = spark.createDataFrame([('{"a": "NaN"}',), ('{"a": NaN}',)], "value string")
    schema = spark.createDataFrame([], "a string").schema
    assert [r.a for r in stream.accepted(stream.decode(messages, schema)).collect()] == ["NaN", None]


def test_build_stops_before_gold_when_a_check_fails(spark):
    shop = bronze(spark)
    doubled = shop.__class__(**{**dict(shop.items()), "products": shop.products.unionAll(shop.products)})
    before = spark.table("gold.fct_order_items").count() if sinks.table_exists(spark, "gold", "fct_order_items") else None
    with pytest.raises(quality.QualityError, match="unique stg_products.product_id"):
        build(spark, doubled, snapshot_date="2018-02-15", horizon_days=30)
    if before is not None:
        assert spark.table("gold.fct_order_items").count() == before


def test_csv_landing_reads_quoted_lines_and_sets_bad_rows_aside(spark, tmp_path):
    reviews = tmp_path / "reviews.csv"
    reviews.write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"line one\nline ""two"", end",2018-01-01 00:00:00,2018-01-02 00:00:00\n'
        "r2,o2,not a number,,,2018-01-01 00:00:00,2018-01-02 00:00:00\n"
    )
    names = tmp_path / "names.csv"
    names.write_text("product_category_name,product_category_name_english\nmoveis,furniture\n123,numbers\n")
    good = csv_files.good_rows(csv_files.read_csv(spark, str(reviews), "order_reviews")).collect()
    assert [(r.review_id, r.review_comment_message) for r in good] == [("r1", 'line one\nline "two", end')]
    # land() wants every table; the others are empty here
    paths = {}
    for table, schema in BRONZE.items():
        path = tmp_path / f"{table}.csv"
        path.write_text(",".join(schema.fieldNames()) + "\n")
        paths[table] = str(path)
    paths |= {"order_reviews": str(reviews), "product_category_name_translation": str(names)}
    target = str(tmp_path / "bronze")
    landed = csv_files.land(spark, paths, target)
    assert landed.order_reviews.count() == 1 and landed.orders.count() == 0
    assert [r[0] for r in landed.product_category_name_translation.orderBy("product_category_name").collect()] == ["123", "moveis"]
    assert spark.read.parquet(f"{target}/order_reviews_rejected").count() == 1
    assert csv_files.land(spark, paths, target).order_reviews.count() == 1  # a second load replaces the first
    assert csv_files.bronze_from(spark, target).order_reviews.count() == 1


def test_events_are_loaded_exactly_once_and_bad_ones_kept_apart(spark, tmp_path):
    folder, target, dead, checkpoint = (str(tmp_path / n) for n in ("in", "out", "dead", "checkpoint"))
    (tmp_path / "in").mkdir()
    event = {"order_id": "o1", "order_status": "delivered", "order_approved_at": float("nan"), "event_timestamp": "x"}
    (tmp_path / "in" / "a.txt").write_text(json.dumps(event) + "\nnot json\n")
    messages = stream.text_folder(spark, folder)
    stream.load(messages, ORDER_EVENT, target, dead, checkpoint)
    (tmp_path / "in" / "b.txt").write_text(json.dumps({**event, "order_id": "o2"}) + "\n")
    stream.load(messages, ORDER_EVENT, target, dead, checkpoint)
    stream.load(messages, ORDER_EVENT, target, dead, checkpoint)
    rows = spark.read.schema(ORDER_EVENT).parquet(target).orderBy("order_id").collect()
    assert [(r.order_id, r.order_approved_at) for r in rows] == [("o1", None), ("o2", None)]
    assert [r.value for r in spark.read.schema("value string").parquet(dead).collect()] == ["not json"]


def test_numeric_nan_becomes_null(spark):
    messages = spark.createDataFrame([('{"a": NaN, "b": 1}',)], "value string")
    schema = spark.createDataFrame([], "a double, b int").schema
    assert tuple(stream.accepted(stream.decode(messages, schema)).first()) == (None, 1)


def test_replay_compresses_history(spark):
    df = spark.createDataFrame([("a", datetime(2018, 1, 1)), ("b", datetime(2018, 1, 31))], "id string, ts timestamp")
    rows = stream.replayed(df, "ts", datetime(2024, 1, 1, tzinfo=timezone.utc)).orderBy("id").collect()
    assert rows[1].event_timestamp - rows[0].event_timestamp == timedelta(minutes=1)


def test_events_round_trip(spark):
    shop = bronze(spark).orders.withColumn("event_timestamp", F.lit("2024-01-01T00:00:00"))
    decoded = stream.accepted(stream.decode(stream.to_events(shop, "order_id"), ORDER_EVENT))
    assert {tuple(r) for r in decoded.collect()} == {tuple(r) for r in shop.collect()}


def test_scratch_tables_live_in_the_shared_folder(spark):
    path = scratch.new_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir", None) or scratch.shared_dir(spark))
    assert scratch.written(spark.range(3).toDF("id"), "x").count() == 3
