"""Facts, dimensions and the three analytical tables that readers and model jobs start from."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import (
    DELIVERED,
    exact_mean,
    month_start,
    months_between_starts,
    one_if,
    ratio,
)
from tradewind.operators.latest import latest_per_key
from tradewind.operators.skew import lookup_join
from tradewind.plans.intermediate import order_day

INACTIVE_AFTER_DAYS = 90
HORIZON_DAYS = 180

FCT_ORDERS_COLUMNS = [
    "order_id", "customer_unique_id", "customer_city", "customer_state", "order_status",
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date", "days_to_deliver",
    "seller_processing_days", "delivered_on_time", "is_delivery_date_missing", "total_payment_value",
    "max_installments", "payment_method_count", "used_credit_card", "used_boleto", "used_voucher",
    "used_debit_card", "review_score", "has_review", "item_count", "items_revenue", "total_freight",
    "distinct_products", "distinct_sellers", "order_month",
]


def items_per_order(items: DataFrame) -> DataFrame:
    """Item count, revenue, freight, distinct products and distinct sellers of each order.

    Each distinct count is a branch of its own, reduced before it is shuffled; two distinct counts in
    one aggregate would send every item three times.
    """
    products = items.groupBy("order_id", "product_id").agg(
        F.count("*").alias("n"), F.sum("price").alias("price"), F.sum("freight_value").alias("freight")
    )
    sellers = items.select("order_id", "seller_id").distinct()
    return (
        products.withColumn("products", F.col("product_id").isNotNull().cast("int")).drop("product_id")
        .unionByName(
            sellers.select("order_id", F.col("seller_id").isNotNull().cast("int").alias("sellers")),
            allowMissingColumns=True,
        )
        .groupBy("order_id")
        .agg(
            F.sum("n").alias("item_count"),
            F.sum("price").alias("items_revenue"),
            F.sum("freight").alias("total_freight"),
            F.sum("products").alias("distinct_products"),
            F.sum("sellers").alias("distinct_sellers"),
        )
    )


def fct_orders(enriched: DataFrame, items: DataFrame) -> DataFrame:
    """Items are aggregated before the join, so an order stays one row."""
    return (
        enriched.join(items_per_order(items), "order_id", "left")
        .withColumn("order_month", month_start(F.col("order_purchase_timestamp")))
        .select(*FCT_ORDERS_COLUMNS)
    )


def fct_order_items(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Every item, also those whose order or product is unknown."""
    order_columns = orders.select(
        "order_id", "customer_unique_id", "order_status", "order_purchase_timestamp", "order_month"
    )
    product_columns = products.select("product_id", "product_category_name", "product_category_name_english")
    return (
        lookup_join(items.join(order_columns, "order_id", "left"), product_columns, "product_id")
        .select(
            "order_id", "order_item_id", "product_id", "seller_id", "customer_unique_id", "order_status",
            "order_purchase_timestamp", "order_month", "product_category_name", "product_category_name_english",
            "shipping_limit_date", "price", "freight_value", "total_item_value",
        )
    )


def dim_customers(customer_orders: DataFrame, customers: DataFrame, geo: DataFrame) -> DataFrame:
    """One row per person with a delivered order; address of the person's greatest customer_id."""
    address = latest_per_key(
        customers,
        "customer_unique_id",
        ["customer_id"],
        ["customer_zip_code_prefix", "customer_city", "customer_state"],
    )
    points = geo.select(
        F.col("zip_code_prefix").alias("customer_zip_code_prefix"),
        F.col("lat").alias("customer_lat"),
        F.col("lng").alias("customer_lng"),
    )
    return lookup_join(
        customer_orders.join(address, "customer_unique_id", "left"), points, "customer_zip_code_prefix"
    ).select(
        "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state",
        "customer_lat", "customer_lng",
        F.col("order_count").alias("frequency"),
        F.col("total_spent").alias("monetary"),
        "avg_order_value", "recency_days", "first_order_date", "last_order_date", "avg_review_score",
        "reviewed_order_count", "delivered_order_count", "max_installments_used",
        "used_credit_card", "used_boleto", "used_voucher",
        (F.col("order_count") > 1).alias("is_repeat_customer"),
        F.coalesce(F.col("recency_days") > INACTIVE_AFTER_DAYS, F.lit(False)).alias("is_inactive"),
    )


def dim_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    return lookup_join(products, translation, "product_category_name").select(
        "product_id",
        "product_category_name",
        F.coalesce("product_category_name_english", "product_category_name").alias("product_category_name_english"),
        "product_name_length", "product_description_length", "product_photos_qty", "product_weight_g",
        "product_length_cm", "product_height_cm", "product_width_cm", "product_volume_cm3",
    )


def dim_sellers(sellers: DataFrame, geo: DataFrame) -> DataFrame:
    points = geo.select(
        F.col("zip_code_prefix").alias("seller_zip_code_prefix"),
        F.col("lat").alias("seller_lat"),
        F.col("lng").alias("seller_lng"),
    )
    return lookup_join(sellers, points, "seller_zip_code_prefix").select(
        "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", "seller_lat", "seller_lng"
    )


def customer_cohorts(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Active customers per (month of the first order, months since).

    The first order counts whatever its status, activity only delivered orders. Both come out of one
    pass: a person's months are a set no larger than the calendar, so one shuffle by person is enough.
    """
    day = order_day()
    per_person = (
        orders.join(customers, "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.trunc(F.min(day), "month").alias("cohort_month"),
            F.collect_set(F.when(F.col("order_status") == DELIVERED, F.trunc(day, "month"))).alias("months"),
        )
    )
    active = per_person.select("customer_unique_id", "cohort_month", F.explode("months").alias("month"))
    return (
        active.filter(F.col("customer_unique_id").isNotNull())
        .groupBy("cohort_month", months_between_starts(F.col("month"), F.col("cohort_month")).alias("months_since_first"))
        .agg(F.count("*").alias("active_customers"))
    )


def seller_performance(items: DataFrame, orders: DataFrame, sellers: DataFrame) -> DataFrame:
    """Quality measures per seller, counted over items.

    Items shrink to one row per (order, seller) before they meet the orders; the distinct products are
    a second, narrow branch. Both meet in one aggregate per seller, so nothing is multiplied by the
    number of distinct counts.
    """
    per_order = items.groupBy("order_id", "seller_id").agg(
        F.count("*").alias("n"),
        F.count("price").alias("n_price"),
        F.sum("price").alias("price"),
        F.sum("freight_value").alias("freight"),
    )
    order_columns = orders.select(
        "order_id", "order_status", "order_purchase_timestamp", "days_to_deliver", "seller_processing_days",
        "delivered_on_time", "review_score", "has_review",
    )
    n = F.col("n")

    def times(name: str):
        return F.col(name) * n

    def known(name: str):
        return F.when(F.col(name).isNotNull(), n)

    measured = per_order.join(order_columns, "order_id", "left").select(
        "seller_id",
        F.col("order_id").isNotNull().cast("int").alias("orders"),
        "price", "n_price", "freight",
        *[times(c).alias(c) for c in ("days_to_deliver", "seller_processing_days", "review_score")],
        *[known(c).alias(f"n_{c}") for c in ("days_to_deliver", "seller_processing_days", "review_score")],
        F.when(F.col("delivered_on_time"), n).otherwise(0).alias("on_time"),
        F.when(F.col("order_status") == DELIVERED, n).otherwise(0).alias("delivered"),
        F.when(F.col("has_review"), n).otherwise(0).alias("reviewed"),
        order_day().alias("sale_date"),
    )
    distinct_products = (
        items.groupBy("seller_id", "product_id").agg(F.lit(1).alias("__any"))
        .select("seller_id", F.col("product_id").isNotNull().cast("int").alias("products"))
    )
    per_seller = (
        measured.unionByName(distinct_products, allowMissingColumns=True)
        .groupBy("seller_id")
        .agg(
            F.sum("orders").alias("total_orders"),
            F.sum("products").alias("distinct_products"),
            F.sum("price").alias("total_revenue"),
            ratio(F.sum("price"), F.sum("n_price")).alias("avg_item_price"),
            F.sum("freight").alias("total_freight_collected"),
            ratio(F.sum("days_to_deliver"), F.sum("n_days_to_deliver")).alias("avg_days_to_deliver"),
            ratio(F.sum("seller_processing_days"), F.sum("n_seller_processing_days")).alias(
                "avg_seller_processing_days"
            ),
            F.sum("on_time").alias("on_time_deliveries"),
            F.sum("delivered").alias("delivered_orders"),
            ratio(F.sum("review_score"), F.sum("n_review_score")).alias("avg_review_score"),
            F.sum("reviewed").alias("reviewed_order_count"),
            F.min("sale_date").alias("first_sale_date"),
            F.max("sale_date").alias("last_sale_date"),
        )
    )
    place = sellers.select("seller_id", "seller_city", "seller_state", "seller_lat", "seller_lng")
    return per_seller.join(place, "seller_id", "left").withColumn(
        "on_time_rate", ratio(F.col("on_time_deliveries"), F.col("delivered_orders"))
    )


def repeat_purchase_training(
    enriched: DataFrame, snapshot_date: date | str | None = None, horizon_days: int = HORIZON_DAYS
) -> DataFrame:
    """Features from orders up to the snapshot T, label from (T, T + horizon].

    Without a snapshot date, T lies one horizon before the last delivered purchase. Features and label
    are conditional aggregates of one pass, so the orders are shuffled by person once.
    """
    delivered = enriched.filter(F.col("order_status") == DELIVERED).withColumn("day", order_day())
    if snapshot_date is None:
        bounds = delivered.agg(F.max("day").alias("outcome_end_date")).select(
            F.date_sub("outcome_end_date", horizon_days).alias("snapshot_date"), "outcome_end_date"
        )
        dated = delivered.crossJoin(F.broadcast(bounds))  # one row
    else:
        snapshot = date.fromisoformat(snapshot_date) if isinstance(snapshot_date, str) else snapshot_date
        dated = delivered.withColumns(
            {
                "snapshot_date": F.lit(snapshot),
                "outcome_end_date": F.lit(snapshot + timedelta(days=horizon_days)),
            }
        )
    seen = F.col("day") <= F.col("snapshot_date")

    def before(name: str):
        return F.when(seen, F.col(name))

    return (
        dated.filter(F.col("day") <= F.col("outcome_end_date"))
        .groupBy("customer_unique_id", "snapshot_date", "outcome_end_date")
        .agg(
            F.count(before("order_id")).alias("frequency"),
            F.sum(before("total_payment_value")).alias("monetary"),
            exact_mean(before("total_payment_value")).alias("avg_order_value"),
            F.min(before("day")).alias("first_day"),
            F.max(before("day")).alias("last_day"),
            F.avg(before("review_score")).alias("avg_review_score"),
            F.sum(one_if(seen & F.col("has_review"))).alias("reviewed_order_count"),
            F.max(before("max_installments")).alias("max_installments_used"),
            F.max(before("used_credit_card")).alias("used_credit_card"),
            F.max(before("used_boleto")).alias("used_boleto"),
            F.max(before("used_voucher")).alias("used_voucher"),
            F.max(~seen).alias("will_repeat"),
        )
        .filter("frequency > 0")
        .select(
            "customer_unique_id", "frequency", "monetary", "avg_order_value",
            F.datediff("snapshot_date", "first_day").alias("tenure_days"),
            F.datediff("snapshot_date", "last_day").alias("recency_at_T"),
            "avg_review_score", "reviewed_order_count", "max_installments_used",
            "used_credit_card", "used_boleto", "used_voucher",
            "snapshot_date", "outcome_end_date", "will_repeat",
        )
    )


