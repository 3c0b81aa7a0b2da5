import hashlib
from datetime import date
from decimal import Decimal

import pytest

from tests.shop import bronze
from tradewind.functions.scalars import surrogate_key, week_start
from tradewind.plans import serving
from tradewind.plans.models import Models
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def m(spark):
    return Models(bronze(spark))


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_orders_have_delivery_measures(m):
    o = by(m.stg_orders, "order_id")
    assert o["o1"].days_to_deliver == 5 and o["o1"].seller_processing_days == 2 and o["o1"].delivered_on_time
    assert o["o2"].days_to_deliver is None and o["o2"].is_delivery_date_missing and o["o2"].delivered_on_time is False
    assert o["o3"].delivered_on_time is False and o["o3"].is_delivery_date_missing is False
    assert o["o4"].delivered_on_time is False
    assert o["o5"].order_approved_at is None and o["o5"].seller_processing_days is None  # unreadable time


def test_payments_are_one_row_per_order(m):
    p = by(m.stg_order_payments, "order_id")
    assert p["o1"].total_payment_value == Decimal("28.50") and p["o1"].max_installments == 3
    assert p["o1"].payment_method_count == 2
    assert (p["o1"].used_credit_card, p["o1"].used_boleto, p["o1"].used_voucher, p["o1"].used_debit_card) == (1, 0, 1, 0)


def test_products_and_sellers(m):
    p = by(m.dim_products, "product_id")
    assert p["p1"].product_category_name_english == "furniture" and p["p1"].product_volume_cm3 == 24.0
    assert p["p2"].product_category_name_english == "raro"
    assert p["p3"].product_category_name_english is None and p["p3"].product_volume_cm3 is None
    s = by(m.dim_sellers, "seller_id")
    assert s["s2"].seller_city == "rio" and s["s2"].seller_state == "RJ"
    assert s["s1"].seller_lat == pytest.approx(-23.6)


def test_enriched_orders_need_a_payment_and_keep_the_latest_review(m):
    e = by(m.int_orders_enriched, "order_id")
    assert set(e) == {"o1", "o2", "o3", "o4", "o6"}
    assert e["o1"].review_id == "r3" and e["o1"].review_score == 4
    assert e["o2"].has_review is False and e["o4"].has_review is True


def test_fct_orders_measures(m):
    f = by(m.fct_orders, "order_id")
    assert len(m.fct_orders.columns) == 29
    assert f["o1"].item_count == 3 and f["o1"].items_revenue == Decimal("25.00")
    assert f["o1"].distinct_products == 2 and f["o1"].distinct_sellers == 2
    assert f["o2"].item_count is None and f["o1"].order_month == date(2018, 1, 1)


def test_orphan_items_stay(m):
    rows = [r for r in m.fct_order_items.collect() if r.order_id == "gone"]
    assert len(rows) == 1 and rows[0].order_status is None and rows[0].product_category_name_english == "furniture"
    assert m.fct_order_items.count() == 6


def test_customers_are_people_with_a_delivered_order(m):
    c = by(m.dim_customers, "customer_unique_id")
    assert set(c) == {"ann", "bob", "cat"}
    ann = c["ann"]
    assert ann.frequency == 2 and ann.monetary == Decimal("37.50") and ann.is_repeat_customer
    assert ann.customer_city == "campinas" and ann.customer_lat == pytest.approx(-22.9)
    assert ann.recency_days == 35 and ann.avg_review_score == 2.5 and ann.reviewed_order_count == 2
    assert c["bob"].recency_days == 63 and c["bob"].is_inactive is False and c["bob"].avg_review_score is None


def test_cohorts_count_the_first_order_whatever_its_status(m):
    cells = {(r.cohort_month, r.months_since_first): r.active_customers for r in m.customer_cohorts.collect()}
    assert cells == {
        (date(2018, 1, 1), 0): 1, (date(2018, 1, 1), 2): 1, (date(2018, 2, 1), 0): 1, (date(2018, 2, 1), 2): 1,
        (date(2018, 3, 1), 0): 1,
    }
    held = {(r.cohort_month, r.months_since_first): r.retention_rate for r in serving.cohort_retention(m.customer_cohorts).collect()}
    assert held[(date(2018, 2, 1), 2)] == 1.0
    true_size = by(serving.retention_of_cohort(m.customer_cohorts, m.stg_orders, m.stg_customers).filter("cohort_month = '2018-02-01'"), "months_since_first")
    assert true_size[0].cohort_size == 2 and true_size[0].retention_rate == 0.5


def test_a_cohort_without_month_zero_has_no_retention(spark):
    cohorts = spark.createDataFrame([(date(2018, 1, 1), 1, 4), (date(2018, 2, 1), 0, 2), (date(2018, 2, 1), 1, 3)],
                                    "cohort_month date, months_since_first int, active_customers bigint")
    rows = serving.cohort_retention(cohorts).collect()
    assert [(r.cohort_month, r.retention_rate) for r in rows] == [(date(2018, 2, 1), 1.0), (date(2018, 2, 1), 1.5)]
    wide = serving.cohort_pivot(serving.cohort_retention(cohorts))
    assert wide.columns == ["cohort", "m0", "m1"] and [tuple(r) for r in wide.collect()] == [("2018-02", 1.0, 1.5)]


def test_the_pivot_holds_every_offset(spark):
    cohorts = spark.createDataFrame([(date(2001, 1, 1), 0, 4), (date(2001, 1, 1), 100, 1)],
                                    "cohort_month date, months_since_first int, active_customers bigint")
    wide = serving.cohort_pivot(serving.cohort_retention(cohorts)).collect()
    assert [r.asDict() for r in wide] == [{"cohort": "2001-01", "m0": 1.0, "m100": 0.25}]


def test_seller_measures_count_items(m):
    s = by(m.seller_performance, "seller_id")
    assert set(s) == {"s1", "s2", "s3"}  # a seller without items has no row
    s1 = s["s1"]
    assert s1.total_orders == 3 and s1.distinct_products == 3 and s1.total_revenue == Decimal("35.00")
    assert s1.delivered_orders == 4 and s1.on_time_deliveries == 3 and s1.on_time_rate == 0.75
    assert s1.avg_days_to_deliver == pytest.approx((5 + 5 + 32 + 4) / 4) and s1.avg_review_score == pytest.approx(3.0)
    assert s1.reviewed_order_count == 3 and s1.avg_item_price == pytest.approx(8.75)
    assert s["s3"].delivered_orders == 0 and s["s3"].on_time_rate is None and s["s3"].total_orders == 1


def test_training_windows(spark):
    dated = Models(bronze(spark), snapshot_date="2018-02-15", horizon_days=30).repeat_purchase_training
    rows = by(dated, "customer_unique_id")
    assert set(rows) == {"ann", "bob"} and rows["ann"].will_repeat and not rows["bob"].will_repeat
    assert rows["ann"].frequency == 1 and rows["ann"].tenure_days == 41 and rows["ann"].recency_at_T == 41
    assert rows["ann"].outcome_end_date == date(2018, 3, 17)
    latest = by(Models(bronze(spark), horizon_days=30).repeat_purchase_training, "customer_unique_id")
    assert latest["ann"].snapshot_date == date(2018, 3, 6) and latest["ann"].frequency == 2
    late = Models(bronze(spark), snapshot_date=date(2020, 1, 1), horizon_days=30).repeat_purchase_training.collect()
    assert {r.will_repeat for r in late} == {False} and late[0].outcome_end_date == date(2020, 1, 31)


def test_readers(m):
    k = serving.kpis(m.fct_orders, m.dim_customers).first()
    assert k.total_revenue == Decimal("67.50") and k.order_count == 4 and k.aov == 16.88 and k.inactive_pct == 0.0
    top = serving.ranked_customers(m.dim_customers, 2).collect()
    assert [r.customer_unique_id for r in top] == ["ann", "bob"]
    assert serving.ranked_customers(m.dim_customers, 1, ascending=True).first().customer_unique_id == "cat"
    assert serving.positive_spend(m.dim_customers).count() == 2


def test_week_starts_on_sunday_and_key_is_null_with_a_null_part(spark):
    df = spark.createDataFrame([(date(2018, 1, 6), "a", None), (date(2018, 1, 7), "a", "b")], "d date, a string, b string")
    rows = df.select(week_start(F.col("d")).alias("w"), surrogate_key(F.col("a"), F.col("b")).alias("k")).collect()
    assert [r.w for r in rows] == [date(2017, 12, 31), date(2018, 1, 7)]
    assert rows[0].k is None and rows[1].k == hashlib.md5(b"a|b").hexdigest()


def test_unused_left_joins_leave_the_plan(m):
    plan = serving.revenue_by_month(m.fct_orders)._jdf.queryExecution().optimizedPlan().toString()
    assert "review" not in plan and "seller_id" not in plan
