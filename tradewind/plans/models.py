"""The model graph: every table by name, each built from the ones it reads.

`Models(bronze)` gives lazy DataFrames; `GoldTables(spark)` gives the same names read from the tables
a build has written. Readers take either.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tradewind.plans import intermediate, marts, staging
from tradewind.sources.bronze import Bronze

STAGING = [
    "stg_orders", "stg_customers", "stg_order_items", "stg_order_payments", "stg_order_reviews",
    "stg_products", "stg_sellers", "stg_geolocation",
]
INTERMEDIATE = ["int_orders_enriched", "int_customer_orders"]
MARTS = [
    "fct_orders", "fct_order_items", "dim_customers", "dim_products", "dim_sellers", "customer_cohorts",
    "seller_performance", "repeat_purchase_training",
]


class Models:
    def __init__(self, bronze: Bronze, snapshot_date=None, horizon_days: int = marts.HORIZON_DAYS):
        self.bronze = bronze
        self.snapshot_date = snapshot_date
        self.horizon_days = horizon_days

    def store(self, name: str, table: DataFrame) -> None:
        """Let everything built from now on read `table` where it would compute the model `name`."""
        self.__dict__[name] = table

    @cached_property
    def stg_orders(self) -> DataFrame:
        return staging.stg_orders(self.bronze.orders)

    @cached_property
    def stg_customers(self) -> DataFrame:
        return staging.stg_customers(self.bronze.customers)

    @cached_property
    def stg_order_items(self) -> DataFrame:
        return staging.stg_order_items(self.bronze.order_items)

    @cached_property
    def stg_order_payments(self) -> DataFrame:
        return staging.stg_order_payments(self.bronze.order_payments)

    @cached_property
    def stg_order_reviews(self) -> DataFrame:
        return staging.stg_order_reviews(self.bronze.order_reviews)

    @cached_property
    def stg_products(self) -> DataFrame:
        return staging.stg_products(self.bronze.products)

    @cached_property
    def stg_sellers(self) -> DataFrame:
        return staging.stg_sellers(self.bronze.sellers)

    @cached_property
    def stg_geolocation(self) -> DataFrame:
        return staging.stg_geolocation(self.bronze.geolocation)

    @cached_property
    def int_orders_enriched(self) -> DataFrame:
        return intermediate.int_orders_enriched(
            self.stg_orders, self.stg_customers, self.stg_order_payments, self.stg_order_reviews
        )

    @cached_property
    def int_customer_orders(self) -> DataFrame:
        return intermediate.int_customer_orders(self.int_orders_enriched)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.int_orders_enriched, self.stg_order_items)

    @cached_property
    def fct_order_items(self) -> DataFrame:
        return marts.fct_order_items(self.stg_order_items, self.fct_orders, self.dim_products)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return marts.dim_customers(self.int_customer_orders, self.stg_customers, self.stg_geolocation)

    @cached_property
    def dim_products(self) -> DataFrame:
        return marts.dim_products(self.stg_products, self.bronze.product_category_name_translation)

    @cached_property
    def dim_sellers(self) -> DataFrame:
        return marts.dim_sellers(self.stg_sellers, self.stg_geolocation)

    @cached_property
    def customer_cohorts(self) -> DataFrame:
        return marts.customer_cohorts(self.stg_orders, self.stg_customers)

    @cached_property
    def seller_performance(self) -> DataFrame:
        return marts.seller_performance(self.stg_order_items, self.fct_orders, self.dim_sellers)

    @cached_property
    def repeat_purchase_training(self) -> DataFrame:
        return marts.repeat_purchase_training(self.int_orders_enriched, self.snapshot_date, self.horizon_days)


class GoldTables:
    """The same names, read from the silver and gold databases."""

    def __init__(self, spark: SparkSession, silver: str = "silver", gold: str = "gold"):
        self._spark, self._silver, self._gold = spark, silver, gold

    def __getattr__(self, name: str) -> DataFrame:
        if name in STAGING or name in INTERMEDIATE:
            return self._spark.table(f"{self._silver}.{name}")
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.table(f"{self._gold}.{name}")
