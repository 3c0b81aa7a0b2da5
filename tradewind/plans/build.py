"""One run of the whole build: staging views, the shared order table, checked gold tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tradewind.plans import quality
from tradewind.plans.models import MARTS, STAGING, GoldTables, Models
from tradewind.sources.sinks import replace_table

STAGED = "__staged"
PARTITIONED = {"fct_orders": "order_month", "fct_order_items": "order_month"}


def build(
    spark: SparkSession, bronze, snapshot_date=None, horizon_days: int | None = None,
    silver: str = "silver", gold: str = "gold", check: bool = True, now: datetime | None = None,
) -> GoldTables:
    """Build every model; gold tables are replaced only after their checks have passed.

    Each mart is written as a table whose name ends in STAGED; the checks read it, and only then does it
    take the place of the gold table, by a rename (partitioned tables: by a copy). Staging models are silver tables, which any session can
    read. With `now`, the age of the newest order is checked too.
    """
    settings = {} if horizon_days is None else {"horizon_days": horizon_days}
    models = Models(bronze, snapshot_date, **settings)
    for database in (silver, gold):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in (*STAGING, "int_orders_enriched", "int_customer_orders"):
        replace_table(getattr(models, name), f"{silver}.{name}")
        models.store(name, spark.table(f"{silver}.{name}"))  # later models read the table
    for name in MARTS:
        replace_table(getattr(models, name), f"{gold}.{name}{STAGED}", PARTITIONED.get(name))
        models.store(name, spark.table(f"{gold}.{name}{STAGED}"))
    try:
        if check:
            quality.enforce(all_checks(models, now))
        for name in MARTS:
            if name in PARTITIONED:  # a rename would leave the partitions' folders behind
                replace_table(spark.table(f"{gold}.{name}{STAGED}"), f"{gold}.{name}", PARTITIONED[name])
            else:
                spark.sql(f"DROP TABLE IF EXISTS {gold}.{name}")
                spark.sql(f"ALTER TABLE {gold}.{name}{STAGED} RENAME TO {gold}.{name}")
    finally:
        for name in MARTS:  # what failed its checks goes
            spark.sql(f"DROP TABLE IF EXISTS {gold}.{name}{STAGED}")
    return GoldTables(spark, silver, gold)


def all_checks(models: Models, now: datetime | None = None) -> DataFrame:
    """Every check on the built tables, one result row each; with `now`, freshness of the orders too."""

    def table(name: str) -> DataFrame:
        return getattr(models, name) if hasattr(models, name) else getattr(models.bronze, name)

    return quality.union(
        [
            quality.not_null_checks(table),
            quality.unique_checks(table),
            quality.accepted_values_checks(table),
            quality.relationship_checks(table),
            quality.payment_positive(models.stg_order_payments),
            quality.training_checks(models.repeat_purchase_training),
            *([quality.freshness(models.bronze.orders, "orders", "order_purchase_timestamp", now).drop("age_hours")] if now else []),
        ]
    )
