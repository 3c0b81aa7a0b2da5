"""RFM segmentation: quintile scores, k-means clusters, and names from how the centroids rank."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.clusters import best_kmeans, silhouettes
from tradewind.operators.quantiles import quantiles
from tradewind.operators.ranking import global_rank
from tradewind.sources.scratch import written
from tradewind.sources.sinks import fit_schema

K_FINAL = 5
K_RANGE = range(3, 9)
RESTARTS = 10
SEED = 42
QUINTILES = 5
FEATURES = ["recency_days", "log_frequency", "log_monetary"]

# Segment names from the best to the worst centroid.
NAMES = ["Champions", "Loyal Customers", "Potential Loyalists", "New Customers", "At Risk"]


def rfm_base(customers: DataFrame) -> DataFrame:
    """The four columns everything here starts from, written once: several passes read them."""
    return written(
        customers.select(
            "customer_unique_id",
            F.col("recency_days").cast("double").alias("recency_days"),
            F.col("frequency").cast("bigint").alias("frequency"),
            F.col("monetary").cast("double").alias("monetary"),
        ),
        "rfm",
    )


def quantile_bin(df: DataFrame, value: str, key: str, name: str, bins: int = QUINTILES) -> DataFrame:
    """df plus `name`, the quantile bin 1..bins of value (right-closed, the lowest value included).

    When two quantile edges coincide, bins are cut over the places 1..n instead, ties broken by key.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = [r.quantile for r in quantiles(df, value, probs).orderBy("prob").collect()]  # bins + 1 numbers
    v = F.col(value)
    if len(set(edges)) == bins + 1:
        bin_ = F.lit(bins)
        for i in range(bins - 1, 0, -1):
            bin_ = F.when(v.cast("double") <= edges[i], i).otherwise(bin_)
        return df.withColumn(name, F.when(v.isNotNull(), bin_))
    total = df.filter(v.isNotNull()).agg(F.count("*").alias("__n"))
    # ceil((place - 1) * bins / (n - 1)) in whole numbers
    cut = F.expr(f"({bins} * (__place - 1) + greatest(__n - 1, 1) - 1) div greatest(__n - 1, 1)")
    return (
        global_rank(df, value, key, "__place")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn(name, F.when(v.isNotNull(), F.greatest(cut, F.lit(1))).cast("int"))
        .drop("__place", "__n")
    )


def rfm_scores(base: DataFrame) -> DataFrame:
    """base plus r_score, f_score, m_score and their sum; a recent purchase scores high."""
    binned = base
    for measure, name in (("recency_days", "r"), ("frequency", "f"), ("monetary", "m")):
        binned = quantile_bin(binned, measure, "customer_unique_id", f"__{name}")
    return (
        binned.withColumn("r_score", (QUINTILES + 1 - F.col("__r")).cast("double"))
        .withColumn("f_score", F.col("__f").cast("double"))
        .withColumn("m_score", F.col("__m").cast("double"))
        .withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
        .drop("__r", "__f", "__m")
    )


def with_features(base: DataFrame) -> DataFrame:
    """Log spend and log order count beside recency; NULL counts as 0."""
    return base.withColumns(
        {
            "log_frequency": F.coalesce(F.log1p("frequency"), F.lit(0.0)),
            "log_monetary": F.coalesce(F.log1p("monetary"), F.lit(0.0)),
        }
    )


def scaling(base: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and spread of each feature: six numbers. A feature without spread is only centred."""
    one = with_features(base).agg(
        *[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"m_{c}") for c in FEATURES],
        *[F.stddev_pop(F.coalesce(c, F.lit(0.0))).alias(f"s_{c}") for c in FEATURES],
    ).first()
    return {c: (one[f"m_{c}"] or 0.0, one[f"s_{c}"] or 1.0) for c in FEATURES}


def standardized(base: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """base plus z_<feature>, written once: every k-means pass reads it."""
    z = {f"z_{c}": (F.coalesce(c, F.lit(0.0)) - mean) / spread for c, (mean, spread) in scale.items()}
    return written(with_features(base).withColumns(z), "standardized")


Z_COLUMNS = [f"z_{c}" for c in FEATURES]


def silhouette_sweep(customers: DataFrame, ks=K_RANGE, restarts: int = RESTARTS) -> DataFrame:
    """Per k: silhouette (mean, squared Euclidean, every row), cost (squared distances within clusters), the same
    between clusters (centres to the overall mean 0), rows, and whether the fit came to rest."""
    base = rfm_base(customers)
    points, key = standardized(base, scaling(base)), ["customer_unique_id"]
    fits = best_kmeans(points, Z_COLUMNS, key, ks, restarts, SEED)
    scores = silhouettes(points, Z_COLUMNS, key, fits)
    rows = [
        (k, float(scores[k]), fit.cost, float((fit.sizes * (fit.centers**2).sum(1)).sum()), int(fit.sizes.sum()), fit.rested)
        for k, fit in sorted(fits.items())
    ]
    return customers.sparkSession.createDataFrame(
        rows, "k int, silhouette double, cost double, between_cost double, customers bigint, converged boolean"
    )


def centroids(centers, scale: dict[str, tuple[float, float]], like: DataFrame) -> DataFrame:
    """One row per cluster in feature units: days, log order count, log spend."""
    rows = [
        (i, *[float(z) * spread + mean for z, (mean, spread) in zip(center, scale.values())])
        for i, center in enumerate(centers)
    ]
    return like.sparkSession.createDataFrame(rows, "cluster int, recency_days double, log_frequency double, log_monetary double")


def label_segments(centers: DataFrame) -> DataFrame:
    """cluster, rank_sum, segment_name for a table of one row per cluster.

    Average ranks of recency (low is good), frequency and spend (high is good) are added; the lowest
    sum is the best segment, ties by cluster. Beyond the five names the next is "Segment 6" and so on.
    """

    orders = {
        "r": (F.col("recency_days").asc(), "recency_days"),
        "f": (F.col("log_frequency").desc(), "log_frequency"),
        "m": (F.col("log_monetary").desc(), "log_monetary"),
    }
    ranked = centers
    for name, (order, column) in orders.items():  # k rows: one task is enough
        place = F.rank().over(Window.orderBy(order))
        tied = F.count("*").over(Window.partitionBy(column))
        ranked = ranked.withColumn(f"__{name}", place + (tied - 1) / 2)
    names = F.array(*[F.lit(n) for n in NAMES])
    position = F.row_number().over(Window.orderBy("rank_sum", "cluster"))
    return (
        ranked.withColumn("rank_sum", F.col("__r") + F.col("__f") + F.col("__m"))
        .withColumn("position", position)
        .select(
            "cluster",
            "rank_sum",
            F.when(F.col("position") <= len(NAMES), F.try_element_at(names, F.col("position")))
            .otherwise(F.concat(F.lit("Segment "), F.col("position").cast("string")))
            .alias("segment_name"),
        )
    )


def segment_rows(assigned: DataFrame, labels: DataFrame, run_id: str, scored_at: datetime) -> DataFrame:
    """The scored table: assigned customers (with cluster and rfm_score) and the name of their cluster."""
    named = assigned.join(F.broadcast(labels.select("cluster", "segment_name")), "cluster", "left")  # k rows
    return fit_schema(
        named.withColumn("segment_id", F.col("cluster"))
        .withColumn("model_run_id", F.lit(run_id))
        .withColumn("scored_at", F.lit(scored_at)),
        "customer_segments",
    )


def clustered(customers: DataFrame, k: int = K_FINAL, restarts: int = RESTARTS):
    """(customers with scores, z columns and cluster; centroids; whether the fit came to rest)."""
    base = rfm_base(customers)
    scale = scaling(base)
    points = standardized(rfm_scores(base), scale)
    fit = best_kmeans(points, Z_COLUMNS, ["customer_unique_id"], [k], restarts, SEED).get(k)
    if fit is None:  # no customers
        return points.withColumn("cluster", F.lit(None).cast("int")), centroids([], scale, base), True
    return points.withColumn("cluster", fit.nearest(Z_COLUMNS)), centroids(fit.centers, scale, base), fit.rested


def customer_segments(
    customers: DataFrame, run_id: str, scored_at: datetime, k: int = K_FINAL, restarts: int = RESTARTS
) -> DataFrame:
    assigned, centers, _ = clustered(customers, k, restarts)
    return segment_rows(assigned, label_segments(centers), run_id, scored_at)
