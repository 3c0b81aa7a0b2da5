"""Data quality checks. Each gives rows (check, table, column, severity, failing_rows).

All NULL checks of a table share one aggregate; checks of keys aggregate before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARN = "error", "warn"

# The order statuses that may occur.
ORDER_STATUSES = [
    "created", "approved", "processing", "invoiced", "shipped", "delivered", "canceled", "unavailable",
]

# What is checked per table. A name in *_warn only warns.
NOT_NULL = {
    "orders": ["order_id", "customer_id"],
    "customers": ["customer_id", "customer_unique_id"],
    "order_items": ["order_id", "product_id", "seller_id"],
    "order_payments": ["order_id", "payment_value"],
    "order_reviews": ["review_id", "order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "geolocation": ["geolocation_zip_code_prefix"],
    "product_category_name_translation": ["product_category_name"],
    "stg_orders": ["order_id", "customer_id", "order_purchase_timestamp"],
    "stg_customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix"],
    "stg_order_items": ["order_id", "order_item_id", "product_id", "seller_id"],
    "stg_order_payments": ["order_id", "total_payment_value"],
    "stg_order_reviews": ["review_id", "order_id"],
    "stg_products": ["product_id"],
    "stg_sellers": ["seller_id", "seller_zip_code_prefix"],
    "stg_geolocation": ["zip_code_prefix"],
    "int_orders_enriched": ["order_id", "customer_unique_id", "total_payment_value"],
    "int_customer_orders": ["customer_unique_id", "order_count", "total_spent"],
    "fct_orders": ["order_id", "customer_unique_id", "total_payment_value", "order_purchase_timestamp", "order_month"],
    "fct_order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price"],
    "dim_customers": [
        "customer_unique_id", "frequency", "monetary", "recency_days", "is_inactive", "is_repeat_customer",
    ],
    "dim_products": ["product_id", "product_category_name_english"],
    "dim_sellers": ["seller_id", "seller_state"],
    "customer_cohorts": ["cohort_month", "months_since_first", "active_customers"],
    "seller_performance": ["seller_id", "total_orders", "total_revenue"],
    "repeat_purchase_training": [
        "customer_unique_id", "will_repeat", "snapshot_date", "frequency", "monetary", "recency_at_T", "tenure_days",
    ],
}
NOT_NULL_WARN = {("dim_products", "product_category_name_english")}

UNIQUE = {
    "orders": ["order_id"],
    "customers": ["customer_id"],
    "order_reviews": ["review_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "product_category_name_translation": ["product_category_name"],
    "stg_orders": ["order_id"],
    "stg_customers": ["customer_id"],
    "stg_order_payments": ["order_id"],
    "stg_order_reviews": ["review_id"],
    "stg_products": ["product_id"],
    "stg_sellers": ["seller_id"],
    "stg_geolocation": ["zip_code_prefix"],
    "int_orders_enriched": ["order_id"],
    "int_customer_orders": ["customer_unique_id"],
    "fct_orders": ["order_id"],
    "dim_customers": ["customer_unique_id"],
    "dim_products": ["product_id"],
    "dim_sellers": ["seller_id"],
    "seller_performance": ["seller_id"],
    "repeat_purchase_training": ["customer_unique_id"],
}
UNIQUE_WARN = {("order_reviews", "review_id"), ("stg_order_reviews", "review_id")}

ACCEPTED = {
    ("orders", "order_status"): ORDER_STATUSES,
    ("stg_orders", "order_status"): ORDER_STATUSES,
    ("fct_orders", "order_status"): ORDER_STATUSES,
    ("repeat_purchase_training", "will_repeat"): [True, False],
}

RELATIONSHIPS = [  # child, its column, parent, severity; the parent's column has the same name
    ("stg_order_items", "product_id", "stg_products", ERROR),
    ("stg_order_items", "seller_id", "stg_sellers", ERROR),
    ("fct_orders", "customer_unique_id", "dim_customers", WARN),  # only delivered orders have a customer row
    ("fct_order_items", "order_id", "fct_orders", WARN),
    ("fct_order_items", "product_id", "dim_products", ERROR),
    ("fct_order_items", "seller_id", "dim_sellers", ERROR),
]

WARN_AFTER_HOURS, ERROR_AFTER_HOURS = 25, 49


def _row(df: DataFrame, check: str, table: str, column: str, severity: str) -> DataFrame:
    """df has one row, one column failing_rows."""
    return df.select(
        F.lit(check).alias("check"), F.lit(table).alias("table"), F.lit(column).alias("column"),
        F.lit(severity).alias("severity"), F.col("failing_rows").cast("bigint").alias("failing_rows"),
    )


def not_null(df: DataFrame, table: str, columns: Sequence[str], warn: set = frozenset()) -> DataFrame:
    """One aggregate for all columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(WARN if (table, c) in warn else ERROR).alias("severity"),
                F.col(c).alias("failing_rows"),
            )
            for c in columns
        ]
    )
    return counts.select(F.explode(cells).alias("c")).select(
        F.lit("not_null").alias("check"), F.lit(table).alias("table"), "c.column", "c.severity", "c.failing_rows"
    )


def unique(df: DataFrame, table: str, column: str, severity: str = ERROR) -> DataFrame:
    """Values that occur more than once; NULL is not a value."""
    repeated = (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("failing_rows"))
    )
    return _row(repeated, "unique", table, column, severity)


def accepted_values(df: DataFrame, table: str, column: str, values: Sequence, severity: str = ERROR) -> DataFrame:
    outside = df.agg(F.count_if(~F.col(column).isin(list(values))).alias("failing_rows"))
    return _row(outside, "accepted_values", table, column, severity)


def relationships(child: DataFrame, table: str, column: str, parent: DataFrame, severity: str = ERROR) -> DataFrame:
    """Rows of the child whose key has no parent; keys are counted first, so a hot key is one row."""
    keys = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    orphans = keys.join(parent.select(column), column, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("failing_rows")
    )
    return _row(orphans, "relationships", table, column, severity)


def rows_failing(df: DataFrame, check: str, table: str, column: str, fails: Column, severity: str = ERROR) -> DataFrame:
    return _row(df.agg(F.count_if(fails).alias("failing_rows")), check, table, column, severity)


def payment_positive(payments: DataFrame) -> DataFrame:
    return rows_failing(
        payments, "payment_value_positive", "stg_order_payments", "total_payment_value",
        F.col("total_payment_value") <= 0, WARN,
    )


def recency_non_negative(training: DataFrame) -> DataFrame:
    return rows_failing(
        training, "recency_non_negative", "repeat_purchase_training", "recency_at_T", F.col("recency_at_T") < 0
    )


def tenure_not_below_recency(training: DataFrame) -> DataFrame:
    return rows_failing(
        training, "tenure_gte_recency", "repeat_purchase_training", "tenure_days",
        F.col("tenure_days") < F.col("recency_at_T"),
    )


def both_label_classes(training: DataFrame) -> DataFrame:
    one = training.agg((F.count_distinct("will_repeat") < 2).cast("bigint").alias("failing_rows"))
    return _row(one, "both_label_classes", "repeat_purchase_training", "will_repeat", ERROR)


def freshness(
    df: DataFrame, table: str, column: str, as_of: datetime,
    warn_hours: int = WARN_AFTER_HOURS, error_hours: int = ERROR_AFTER_HOURS,
) -> DataFrame:
    """One row; severity is pass, warn or error by the age of the newest row at as_of."""
    newest = df.agg(F.max(F.col(column).cast("timestamp")).alias("newest"))
    age = (F.unix_seconds(F.lit(as_of)) - F.unix_seconds("newest")) / 3600
    return newest.withColumn("age_hours", age).select(
        F.lit("freshness").alias("check"), F.lit(table).alias("table"), F.lit(column).alias("column"),
        F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), ERROR)
        .when(F.col("age_hours") > warn_hours, WARN).otherwise("pass").alias("severity"),
        F.when(F.col("age_hours") <= warn_hours, 0).otherwise(1).cast("bigint").alias("failing_rows"),
        "age_hours",
    )


def union(results: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def not_null_checks(table_of, tables: Sequence[str] | None = None) -> DataFrame:
    """table_of: name -> DataFrame."""
    return union([not_null(table_of(t), t, NOT_NULL[t], NOT_NULL_WARN) for t in tables or NOT_NULL])


def unique_checks(table_of, tables: Sequence[str] | None = None) -> DataFrame:
    return union(
        [
            unique(table_of(t), t, c, WARN if (t, c) in UNIQUE_WARN else ERROR)
            for t in tables or UNIQUE for c in UNIQUE[t]
        ]
    )


def accepted_values_checks(table_of) -> DataFrame:
    return union([accepted_values(table_of(t), t, c, v) for (t, c), v in ACCEPTED.items()])


def relationship_checks(table_of) -> DataFrame:
    return union([relationships(table_of(c), c, key, table_of(p), s) for c, key, p, s in RELATIONSHIPS])


def training_checks(training: DataFrame) -> DataFrame:
    return union([recency_non_negative(training), tenure_not_below_recency(training), both_label_classes(training)])


class QualityError(RuntimeError):
    pass


def enforce(results: DataFrame) -> list:
    """Raise if a check of severity error has failing rows; return the failing checks that only warn."""
    failing = results.filter(F.col("failing_rows") > 0).collect()  # one row per check
    errors = [r for r in failing if r["severity"] == ERROR]
    if errors:
        raise QualityError("; ".join(f"{r.check} {r.table}.{r.column}: {r.failing_rows}" for r in errors))
    return failing
