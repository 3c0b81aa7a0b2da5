"""Equal-width histograms: two aggregates over one narrow column, every bin in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.sources.scratch import written


def histogram(df: DataFrame, value: str, bins: int, cap: float | None = None, stored: bool = False) -> DataFrame:
    """bin, bin_start, bin_end, n. The last bin is closed.

    With a `cap`, the bins divide the values up to it, and one more row counts those above, from the cap
    to the largest value (NULL when there is none).

    The range must be known before the rows are counted. Unless df is a stored table, its one column is
    written first, so that what df computes is computed once.
    """
    v = F.col(value).cast("double")
    known = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    if not stored:
        known = written(known, "histogram")
    every, known = known, known if cap is None else known.filter(F.col("v") <= cap)
    span = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn(
        "width", (F.col("hi") - F.col("lo")) / bins
    )
    at = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("width"))), F.lit(0))
    counted = (
        known.crossJoin(F.broadcast(span))  # one row
        .groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = (
        grid.crossJoin(F.broadcast(span.filter("lo is not null")))
        .join(F.broadcast(counted), "bin", "left")  # at most `bins` rows
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
    if cap is None:
        return rows
    above = every.filter(F.col("v") > cap).agg(F.max("v").alias("bin_end"), F.count("*").alias("n"))
    return rows.unionByName(above.select(F.lit(bins).alias("bin"), F.lit(float(cap)).alias("bin_start"), "bin_end", "n"))
