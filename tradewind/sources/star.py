"""A star schema (orders, lineitem, customer, ...) read as the nine raw commerce tables.

Only columns that a query asks for reach the Parquet scan; the joins that merely add columns sit on
unique keys, so Catalyst drops those a query does not use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# How the star schema's codes stand in for the commerce ones.
STATUS = {"F": "delivered", "O": "shipped", "P": "processing"}
PAYMENT = {"N": "credit_card", "R": "boleto", "A": "voucher"}
UNTRANSLATED_CATEGORY = "ECONOMY"


# Fixed schemas, so that no job runs just to look at the files.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(os.path.join(directory, f"{name}.parquet"))
    return df.withColumn(TIMES[name], F.col(TIMES[name]).cast("timestamp")) if name in TIMES else df


def _coded(column: str, codes: dict[str, str]):
    value = F.lit(None).cast("string")
    for code, name in codes.items():
        value = F.when(F.col(column) == code, name).otherwise(value)
    return value


def _price():
    return F.col("l_extendedprice").cast("decimal(12,2)")


def orders(spark: SparkSession, directory: str) -> DataFrame:
    shipped = (
        read_table(spark, directory, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    )
    status = _coded("o_orderstatus", STATUS)
    day = F.expr("interval 1 day")
    return (
        read_table(spark, directory, "orders")
        .join(shipped, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderkey").alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            (F.col("o_orderdate") + day).alias("order_approved_at"),
            F.col("first_ship").alias("order_delivered_carrier_date"),
            F.when(status == "delivered", F.col("last_ship")).alias("order_delivered_customer_date"),
            (F.col("o_orderdate") + F.expr("interval 30 day")).alias("order_estimated_delivery_date"),
        )
    )


def customers(spark: SparkSession, directory: str) -> DataFrame:
    nation = read_table(spark, directory, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    people = read_table(spark, directory, "customer").join(nation, "c_nationkey")
    return (
        read_table(spark, directory, "orders")
        .select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
        .join(people, "c_custkey")
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def order_items(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        _price().alias("price"),
        (_price() * F.col("l_tax").cast("decimal(4,2)")).alias("freight_value"),
    )


def order_payments(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        _coded("l_returnflag", PAYMENT).alias("payment_type"),
        F.col("l_quantity").cast("bigint").alias("payment_installments"),
        (_price() * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))).alias("payment_value"),
    )


def order_reviews(spark: SparkSession, directory: str) -> DataFrame:
    first_lines = read_table(spark, directory, "lineitem").filter("l_linenumber = 1")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return first_lines.select(
        F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                          F.col("l_suppkey").cast("string"), day)).alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.col("l_shipdate").alias("review_creation_date"),
        F.col("l_shipdate").alias("review_answer_timestamp"),
    )


def products(spark: SparkSession, directory: str) -> DataFrame:
    size = F.col("p_size")
    return read_table(spark, directory, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_brand").alias("product_description_lenght"),
        (size % 7).alias("product_photos_qty"),
        F.col("p_retailprice").alias("product_weight_g"),
        size.cast("double").alias("product_length_cm"),
        (size % 10 + 1).cast("double").alias("product_height_cm"),
        (size % 5 + 1).cast("double").alias("product_width_cm"),
    )


def translation(spark: SparkSession, directory: str) -> DataFrame:
    return (
        read_table(spark, directory, "part")
        .filter(F.col("p_type") != UNTRANSLATED_CATEGORY)
        .groupBy(F.col("p_type").alias("product_category_name"))
        .agg(F.lower(F.max("p_type")).alias("product_category_name_english"))
    )


def sellers(spark: SparkSession, directory: str) -> DataFrame:
    nation = read_table(spark, directory, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return (
        read_table(spark, directory, "supplier")
        .join(nation, "s_nationkey")
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").alias("seller_zip_code_prefix"),
            F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")).alias("seller_city"),
            F.lower("n_name").alias("seller_state"),
        )
    )


def geolocation(spark: SparkSession, directory: str) -> DataFrame:
    nation = read_table(spark, directory, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return (
        read_table(spark, directory, "customer")
        .join(nation, "c_nationkey")
        .select(
            F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
            (F.col("c_acctbal") / 100).alias("geolocation_lat"),
            (F.col("c_custkey") % 180).cast("double").alias("geolocation_lng"),
            F.col("c_mktsegment").alias("geolocation_city"),
            F.col("n_name").alias("geolocation_state"),
        )
    )


class StarBronze:
    """The nine raw tables by name, each built when it is first asked for."""

    _builders = {
        "orders": orders,
        "customers": customers,
        "order_items": order_items,
        "order_payments": order_payments,
        "order_reviews": order_reviews,
        "products": products,
        "sellers": sellers,
        "geolocation": geolocation,
        "product_category_name_translation": translation,
    }

    def __init__(self, spark: SparkSession, directory: str):
        self._spark, self._directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._builders:
            raise AttributeError(name)
        table = self._builders[name](self._spark, self._directory)
        setattr(self, name, table)
        return table

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self._builders]


def bronze(spark: SparkSession, directory: str) -> StarBronze:
    return StarBronze(spark, directory)


def experiments(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(continuous, proportion) experiment rows from the event table: experiment, arm, unit_id, value."""
    events = read_table(spark, directory, "events")
    arm = F.when(F.col("user_id") % 2 == 0, "control").otherwise("variant")
    continuous = events.select(
        F.col("event_type").alias("experiment"), arm.alias("arm"), F.col("event_id").alias("unit_id"), "value"
    )
    proportion = events.select(
        F.to_date("ts").alias("experiment"), arm.alias("arm"), F.col("event_id").alias("unit_id"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("value"),
    )
    return continuous, proportion
