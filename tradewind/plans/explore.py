"""Exploratory aggregates over the marts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import DELIVERED
from tradewind.operators.histogram import histogram
from tradewind.operators.quantiles import median
from tradewind.sources.scratch import written

CORRELATED = [
    "frequency", "monetary", "avg_order_value", "recency_days", "avg_review_score", "max_installments_used",
]


def table_counts(**tables: DataFrame) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def monthly_orders_all(orders: DataFrame) -> DataFrame:
    """Orders per month whatever their status."""
    return orders.groupBy("order_month").agg(F.count("order_id").alias("order_count")).orderBy("order_month")


def data_span(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.min("order_purchase_timestamp").alias("first_order"), F.max("order_purchase_timestamp").alias("last_order")
    )


def last_order_histogram(customers: DataFrame, bins: int = 50) -> DataFrame:
    """Bins over days since 1970-01-01."""
    return histogram(customers.select(F.unix_date("last_order_date").alias("day")), "day", bins)


def frequency_distribution(customers: DataFrame, first: int = 10) -> DataFrame:
    """Customers per number of orders, the smallest `first` numbers, with the share of one-time buyers."""
    per_value = (
        customers.filter(F.col("frequency").isNotNull())
        .groupBy("frequency").agg(F.count("*").alias("customers")).orderBy("frequency").limit(first)
    )
    share = customers.agg((F.avg((F.col("frequency") == 1).cast("int")) * 100).alias("pct_one_time"))
    return per_value.crossJoin(F.broadcast(share)).orderBy("frequency")  # one row


def revenue_by_state_top(orders: DataFrame, n: int = 15) -> DataFrame:
    return (
        orders.filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state").agg(F.sum("total_payment_value").alias("revenue"))
        .orderBy(F.col("revenue").desc(), "customer_state").limit(n)
    )


def review_distribution(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(F.col("review_score").isNotNull())
        .groupBy("review_score").agg(F.count("*").alias("n")).orderBy("review_score")
    )


def _delivered_with_days(orders: DataFrame) -> DataFrame:
    return orders.filter((F.col("order_status") == DELIVERED) & F.col("days_to_deliver").isNotNull())


def delivery_sla(orders: DataFrame) -> DataFrame:
    """Share delivered on time in percent, and the median number of days."""
    known = _delivered_with_days(orders)
    on_time = known.agg(
        F.count("*").alias("delivered"), (F.avg(F.col("delivered_on_time").cast("int")) * 100).alias("on_time_pct")
    )
    middle = median(known, "days_to_deliver").withColumnRenamed("median", "median_days")
    return on_time.crossJoin(F.broadcast(middle))  # one row each


def delivery_days_histogram(orders: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(_delivered_with_days(orders), "days_to_deliver", bins)


def payment_mix(customers: DataFrame) -> DataFrame:
    """Customers who ever used each payment method."""
    used = customers.agg(
        F.sum("used_credit_card").alias("Credit Card"), F.sum("used_boleto").alias("Boleto"),
        F.sum("used_voucher").alias("Voucher"),
    )
    return used.unpivot([], ["Credit Card", "Boleto", "Voucher"], "method", "customers")


def category_revenue_top(items: DataFrame, n: int = 15) -> DataFrame:
    return (
        items.filter(F.col("product_category_name_english").isNotNull())
        .groupBy("product_category_name_english").agg(F.sum("price").alias("revenue"))
        .orderBy(F.col("revenue").desc(), "product_category_name_english").limit(n)
    )


def rfm_histograms(customers: DataFrame) -> DataFrame:
    """Recency and log spend in 50 bins, mean review score in 20."""
    parts = [
        ("recency_days", F.col("recency_days"), 50),
        ("log_monetary", F.log1p(F.col("monetary").cast("double")), 50),
        ("avg_review_score", F.col("avg_review_score"), 20),
    ]
    table = written(customers.select(*[column.cast("double").alias(name) for name, column, _ in parts]), "measures")
    result = None
    for name, _, bins in parts:
        part = histogram(table, name, bins, stored=True).withColumn("measure", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


def rfm_correlation(customers: DataFrame) -> DataFrame:
    """Pearson matrix in long form, pairwise-complete: each pair uses the rows where both are known.

    One aggregate over the customers; 15 coefficients fan out to 36 cells afterwards.
    """
    pairs = list(combinations(CORRELATED, 2))
    values = customers.select(*[F.col(c).cast("double").alias(c) for c in CORRELATED])
    one = values.agg(
        *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count(c).alias(f"n_{c}") for c in CORRELATED],
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells += [(a, b, F.col(f"r{i}")), (b, a, F.col(f"r{i}"))]
    cells += [(c, c, F.when(F.col(f"n_{c}") > 1, F.lit(1.0))) for c in CORRELATED]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")) for a, b, r in cells])
    return one.select(F.explode(rows).alias("c")).select(
        F.col("c.a").alias("feature_a"), F.col("c.b").alias("feature_b"), F.col("c.r").alias("correlation")
    )


