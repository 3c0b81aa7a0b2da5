"""Weekly demand per category: eligible series, hold-out, two models, metrics and forecast rows.

Rows only meet in sums and in windows over one category's weeks, which the calendar bounds. The axis
that grows is the number of categories.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.least_squares import solve_per_group
from tradewind.sources.sinks import fit_schema

MIN_WEEKS = 10
HORIZON = 12
TOP_CATEGORIES = 10
TRIM_TAIL_WEEKS = 2
MOST_ZEROS = 0.5
FOURIER_ORDER = 3
RIDGE = 0.1  # on the seasonal terms only; keeps a series with few weeks from being interpolated
Z95 = 1.959963984540054
TINY = 1e-9


def top_categories(weekly: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    return (
        weekly.groupBy("category").agg(F.sum("order_count").alias("total_orders"))
        .orderBy(F.col("total_orders").desc(), "category").limit(n)
    )


def only_top(weekly: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    return weekly.join(F.broadcast(top_categories(weekly, n).select("category")), "category", "left_semi")  # n rows


def fill_gaps(weekly: DataFrame) -> DataFrame:
    """Every week between a category's first and last one, absent weeks with 0 orders."""
    grid = weekly.groupBy("category").agg(F.min("week").alias("a"), F.max("week").alias("b")).select(
        "category", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week")
    )
    return grid.join(weekly, ["category", "week"], "left").select(
        "category", "week", F.coalesce("order_count", F.lit(0)).alias("order_count")
    )


def eligible_series(weekly: DataFrame, gaps: bool = False) -> DataFrame:
    """Weeks of the series worth fitting, without their last two; adds n_weeks and week_no (1 = first).

    A series with fewer than ten weeks left, or with zeros in more than half of them, is left out.
    """
    rows = fill_gaps(weekly) if gaps else weekly
    per_category = Window.partitionBy("category")
    trimmed = (
        rows.withColumn("__from_end", F.row_number().over(per_category.orderBy(F.col("week").desc())))
        .withColumn("__n", F.count("*").over(per_category))
        .filter((F.col("__n") <= TRIM_TAIL_WEEKS) | (F.col("__from_end") > TRIM_TAIL_WEEKS))
    )
    return (
        trimmed.withColumn("n_weeks", F.count("*").over(per_category).cast("int"))
        .withColumn("__zeros", F.avg((F.col("order_count") == 0).cast("int")).over(per_category))
        .withColumn("week_no", F.row_number().over(per_category.orderBy("week")))
        .filter((F.col("n_weeks") >= MIN_WEEKS) & (F.col("__zeros") <= MOST_ZEROS))
        .select("category", "week", "order_count", "n_weeks", "week_no")
    )


def holdout_split(series: DataFrame) -> DataFrame:
    """series plus holdout (weeks kept back: a quarter, 1 to 12) and is_test."""
    held = F.least(F.lit(HORIZON), F.greatest(F.lit(1), F.floor(F.col("n_weeks") / 4))).cast("int")
    return series.withColumn("holdout", held).withColumn("is_test", F.col("week_no") > F.col("n_weeks") - F.col("holdout"))


def future_weeks(series: DataFrame) -> DataFrame:
    """category, week: the twelve Sundays after the last week of the series."""
    last = series.groupBy("category").agg(F.max("week").alias("last"), F.min("week").alias("first"))
    ahead = F.expr(f"sequence(date_add(last, 7), date_add(last, {7 * HORIZON}), interval 7 days)")
    return last.select("category", "first", F.explode(ahead).alias("week"))


def _terms(order: int) -> dict:
    """Regression terms of a row with `first` and `week`: intercept, years since the start, Fourier pairs."""
    years = F.datediff("week", "first") / F.lit(365.25)
    angle = F.dayofyear("week") * F.lit(2 * np.pi / 365.25)
    terms = {"x0": F.lit(1.0), "x1": years}
    for k in range(1, order + 1):
        terms[f"x{2 * k}"] = F.sin(angle * k)
        terms[f"x{2 * k + 1}"] = F.cos(angle * k)
    return terms


def _fits(split_rows: DataFrame) -> DataFrame:
    """Each row once per fit it belongs to: 'all' always, 'train' unless it is held out."""
    fits = F.when(F.col("is_test"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("train")))
    return split_rows.withColumn("fit", F.explode(fits))


def _with_terms(split_rows: DataFrame, order: int) -> DataFrame:
    first = split_rows.withColumn("first", F.min("week").over(Window.partitionBy("category")))
    return first.withColumns({**_terms(order), "y": F.col("order_count").cast("double")})


def _penalty(order: int) -> list[float]:
    return [0.0, 0.0] + [RIDGE] * (2 * order)


def _regression(rows: DataFrame, order: int) -> DataFrame:
    """category, beta (array), sigma (residual standard deviation) of the fit on rows with terms."""
    return solve_per_group(rows, ["category"], [f"x{i}" for i in range(2 + 2 * order)], "y", _penalty(order))


def normal_residuals(split_rows: DataFrame, order: int = FOURIER_ORDER) -> DataFrame:
    """category, residual: the largest relative gap in the normal equations of the fit on every week."""
    rows = _with_terms(split_rows, order)
    fitted = rows.join(_regression(rows, order).select("category", "beta"), "category")
    gaps = []
    for i, penalty in enumerate(_penalty(order)):
        x = F.col(f"x{i}")
        gap = F.sum(x * (F.col("y") - _dot(order))) - penalty * F.max(F.col("beta")[i])
        gaps.append(F.abs(gap) / (1 + F.sum(F.abs(x * F.col("y")))))
    return fitted.groupBy("category").agg(F.greatest(*gaps).alias("residual"))


def _dot(order: int):
    return sum((F.col("beta")[i] * F.col(f"x{i}") for i in range(2 + 2 * order)), F.lit(0.0))


def regression_holdout(split_rows: DataFrame, order: int = FOURIER_ORDER) -> DataFrame:
    """category, week, y_true, y_pred of the held-out weeks, predicted by the fit on the rest."""
    rows = _with_terms(split_rows, order)
    beta = _regression(rows.filter("not is_test"), order).select("category", "beta")
    return (
        rows.filter("is_test").join(beta, "category")
        .select(
            "category", "week", F.col("order_count").cast("double").alias("y_true"),
            F.greatest(_dot(order), F.lit(0.0)).alias("y_pred"),
        )
    )


def regression_future(split_rows: DataFrame, order: int = FOURIER_ORDER) -> DataFrame:
    """category, week, yhat, yhat_lower, yhat_upper, model for the weeks ahead, fitted on every week."""
    beta = _regression(_with_terms(split_rows, order), order).select("category", "beta", "sigma")
    name = "linear_trend" if order == 0 else "trend_fourier"
    return (
        future_weeks(split_rows).withColumns(_terms(order)).join(beta, "category")
        .withColumn("point", _dot(order))
        .select(
            "category", "week", F.greatest("point", F.lit(0.0)).alias("yhat"),
            (F.col("point") - Z95 * F.col("sigma")).alias("yhat_lower"),
            (F.col("point") + Z95 * F.col("sigma")).alias("yhat_upper"),
            F.lit(name).alias("model"),
        )
    )


# Smoothing weights tried for level, trend and season.
LEVELS = (0.05, 0.1, 0.2, 0.4, 0.6, 0.8)
TRENDS = (0.0, 0.05, 0.1, 0.3)
SEASONS = (0.05, 0.1, 0.3, 0.6)


def season_length(n: int) -> int:
    """Weeks in a season for a fit on n weeks; 0 (trend only) when two seasons do not fit."""
    season = min(52, max(4, n // 2))
    return season if n >= 2 * season else 0


def smooth(y: np.ndarray, season: int, level_w: float, trend_w: float, season_w: float, ahead: int):
    """Additive Holt-Winters over one series: (squared one-step errors, forecasts)."""
    if season:
        level = float(y[:season].mean())
        trend = float(y[season:2 * season].mean() - level) / season
        level -= trend * (season + 1) / 2
        seasonal = [float(v) - (level + trend * (i + 1)) for i, v in enumerate(y[:season])]
    else:
        trend = float(y[1] - y[0]) if len(y) > 1 else 0.0
        level, seasonal = float(y[0]) - trend, [0.0]
    errors, m = 0.0, len(seasonal)
    for i, value in enumerate(y):
        expected = level + trend + seasonal[i % m]
        errors += (value - expected) ** 2
        new_level = level_w * (value - seasonal[i % m]) + (1 - level_w) * (level + trend)
        trend = trend_w * (new_level - level) + (1 - trend_w) * trend
        if season:
            seasonal[i % m] = season_w * (value - new_level) + (1 - season_w) * seasonal[i % m]
        level = new_level
    n = len(y)
    return errors, [level + trend * (h + 1) + seasonal[(n + h) % m] for h in range(ahead)]


def _try_weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        errors, paths = [], []
        for y, a, b, c in zip(batch["y"], batch["level_w"], batch["trend_w"], batch["season_w"]):
            values = np.asarray(y, dtype=float)
            error, path = smooth(values, season_length(len(values)), a, b, c, HORIZON)
            errors.append(error)
            paths.append(path)
        yield batch[["category", "fit"]].assign(error=errors, path=paths)


def _holt_winters(split_rows: DataFrame) -> DataFrame:
    """category, fit, path (next twelve values) of the weights with the smallest squared error.

    Series (one array of weeks each) times weights are independent rows, spread over the cluster.
    """
    spark = split_rows.sparkSession
    weights = spark.createDataFrame(
        [(a, b, c) for a in LEVELS for b in TRENDS for c in SEASONS], "level_w double, trend_w double, season_w double"
    )
    series = (
        _fits(split_rows).groupBy("category", "fit")
        .agg(F.sort_array(F.collect_list(F.struct("week", F.col("order_count").cast("double").alias("y")))).alias("s"))
        .select("category", "fit", F.transform("s", lambda r: r["y"]).alias("y"))
    )
    # Few bytes, a lot of work per series: spread by key instead of by bytes. By its hash, because a
    # repartition by the grouping columns themselves would be dropped and the partitions merged.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tried = series.repartition(tasks, F.xxhash64("category", "fit")).crossJoin(F.broadcast(weights)).mapInPandas(  # 96 rows
        _try_weights, "category string, fit string, error double, path array<double>"
    )
    return tried.groupBy("category", "fit").agg(F.min_by("path", "error").alias("path"))


def smoothing_holdout(split_rows: DataFrame) -> DataFrame:
    path = _holt_winters(split_rows).filter("fit = 'train'").select("category", "path")
    step = F.col("week_no") - (F.col("n_weeks") - F.col("holdout"))
    return (
        split_rows.filter("is_test").join(path, "category")
        .select(
            "category", "week", F.col("order_count").cast("double").alias("y_true"),
            F.greatest(F.element_at("path", step.cast("int")), F.lit(0.0)).alias("y_pred"),
        )
    )


def smoothing_future(split_rows: DataFrame) -> DataFrame:
    path = _holt_winters(split_rows).filter("fit = 'all'").select("category", F.posexplode("path").alias("i", "v"))
    last = split_rows.groupBy("category").agg(F.max("week").alias("last"))
    return path.join(last, "category").select(
        "category", F.expr("date_add(last, 7 * (i + 1))").alias("week"), F.greatest("v", F.lit(0.0)).alias("yhat"),
        F.lit(None).cast("double").alias("yhat_lower"), F.lit(None).cast("double").alias("yhat_upper"),
        F.lit("exponential_smoothing").alias("model"),
    )


def forecast_metrics(predicted: DataFrame) -> DataFrame:
    """Per category: mean absolute error, sMAPE, MAPE (zero actuals skipped, NULL if all are zero), rounded."""
    y, p = F.col("y_true"), F.col("y_pred")
    return (
        predicted.groupBy("category")
        .agg(
            F.round(F.avg(F.abs(y - p)), 2).alias("mae"),
            F.round(F.avg(2 * F.abs(y - p) / (F.abs(y) + F.abs(p) + TINY)), 4).alias("smape"),
            F.round(F.avg(F.when(y != 0, F.abs((y - p) / F.when(y != 0, y)))), 4).alias("mape"),
        )
        .orderBy("category")
    )


def demand_forecasts(forecast: DataFrame, run_id: str, scored_at: datetime) -> DataFrame:
    """The scored table."""
    return fit_schema(
        forecast.withColumn("model_run_id", F.lit(run_id)).withColumn("scored_at", F.lit(scored_at)),
        "demand_forecasts",
    )
