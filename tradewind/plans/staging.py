"""Cleaned raw tables: renames, parsing, flags, and the two aggregates that remove fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import DELIVERED, days_between, exact_mean, flag, one_if, timestamp_of
from tradewind.schemas import COORDINATE

ORDER_TIMES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


def stg_orders(orders: DataFrame) -> DataFrame:
    delivered, estimated = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    return (
        orders.select(
            "order_id", "customer_id", "order_status", *[timestamp_of(orders, c).alias(c) for c in ORDER_TIMES]
        )
        .withColumns(
            {
                "days_to_deliver": days_between(delivered, F.col("order_purchase_timestamp")),
                "seller_processing_days": days_between(
                    F.col("order_delivered_carrier_date"), F.col("order_approved_at")
                ),
                "delivered_on_time": flag(delivered <= estimated),
                "is_delivery_date_missing": flag((F.col("order_status") == DELIVERED) & delivered.isNull()),
            }
        )
    )


def stg_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        F.lower(F.trim("customer_city")).alias("customer_city"),
        F.upper("customer_state").alias("customer_state"),
    )


def stg_order_items(items: DataFrame) -> DataFrame:
    return items.select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        timestamp_of(items, "shipping_limit_date").alias("shipping_limit_date"),
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("total_item_value"),
    )


def stg_order_payments(payments: DataFrame) -> DataFrame:
    def used(kind: str):
        return F.max(one_if(F.col("payment_type") == kind)).alias(f"used_{kind}")

    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("total_payment_value"),
        F.max("payment_installments").alias("max_installments"),
        F.count_distinct("payment_type").alias("payment_method_count"),
        used("credit_card"),
        used("boleto"),
        used("voucher"),
        used("debit_card"),
    )


def stg_order_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.select(
        "review_id",
        "order_id",
        "review_score",
        "review_comment_title",
        "review_comment_message",
        timestamp_of(reviews, "review_creation_date").alias("review_creation_date"),
        timestamp_of(reviews, "review_answer_timestamp").alias("review_answer_timestamp"),
    )


def stg_products(products: DataFrame) -> DataFrame:
    volume = F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")
    return products.select(
        "product_id",
        "product_category_name",
        F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"),
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
        volume.alias("product_volume_cm3"),
    )


def stg_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select(
        "seller_id",
        "seller_zip_code_prefix",
        F.lower(F.trim("seller_city")).alias("seller_city"),
        F.upper("seller_state").alias("seller_state"),
    )


def stg_geolocation(points: DataFrame) -> DataFrame:
    """One row per zip. Coordinates are averaged over exact sums, so the row order does not matter."""
    return points.groupBy(F.col("geolocation_zip_code_prefix").alias("zip_code_prefix")).agg(
        exact_mean(F.col("geolocation_lat").cast(COORDINATE)).alias("lat"),
        exact_mean(F.col("geolocation_lng").cast(COORDINATE)).alias("lng"),
        F.max("geolocation_state").alias("state"),
        F.max("geolocation_city").alias("city"),
    )


