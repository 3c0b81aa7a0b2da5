"""Orders with everything known about them, and the per-person aggregate built on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import DELIVERED, exact_mean, one_if
from tradewind.operators.latest import latest_per_key

REVIEW_COLUMNS = ["review_id", "review_score", "review_comment_title", "review_comment_message"]


def int_orders_enriched(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, reviews: DataFrame
) -> DataFrame:
    """One row per order that has a customer and a payment; the latest answered review if there is one.

    Customers come first: after that every join is on order_id and reuses one partitioning.
    """
    latest = latest_per_key(
        reviews, "order_id", ["review_answer_timestamp", "review_id", "review_score"], REVIEW_COLUMNS
    )
    return (
        orders.join(customers, "customer_id")
        .join(payments, "order_id")
        .join(latest, "order_id", "left")
        .withColumn("has_review", F.col("review_id").isNotNull())
    )


def order_day():
    return F.to_date("order_purchase_timestamp")


def int_customer_orders(enriched: DataFrame) -> DataFrame:
    """Delivered orders per person; recency counts back from the last delivered purchase in the data."""
    delivered = enriched.filter(F.col("order_status") == DELIVERED)
    bounds = delivered.agg(F.max(order_day()).alias("max_purchase_date"))
    per_person = delivered.groupBy("customer_unique_id").agg(
        F.count("order_id").alias("order_count"),
        F.sum("total_payment_value").alias("total_spent"),
        exact_mean(F.col("total_payment_value")).alias("avg_order_value"),
        F.min(order_day()).alias("first_order_date"),
        F.max(order_day()).alias("last_order_date"),
        F.avg("review_score").alias("avg_review_score"),
        F.sum(one_if(F.col("has_review"))).alias("reviewed_order_count"),
        F.max("max_installments").alias("max_installments_used"),
        F.max("used_credit_card").alias("used_credit_card"),
        F.max("used_boleto").alias("used_boleto"),
        F.max("used_voucher").alias("used_voucher"),
    )
    return (
        per_person.crossJoin(F.broadcast(bounds))  # one row
        .withColumn("recency_days", F.datediff("max_purchase_date", "last_order_date"))
        .withColumn("delivered_order_count", F.col("order_count"))
        .drop("max_purchase_date")
    )
