"""Exact quantiles with linear interpolation, found by position in the running counts.

The built-in exact percentile keeps every distinct value of a group in one task; this one does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ranking import running_totals, value_counts


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """One row per group and probability: prob, quantile."""
    if approximate:
        cuts = F.percentile_approx(value, list(probs), 10_000).alias("q")
        rows = df.groupBy(*group).agg(cuts).select(*group, F.posexplode("q").alias("i", "quantile"))
        return rows.select(*group, F.element_at(F.lit(list(probs)), F.col("i") + 1).alias("prob"), "quantile")
    ranked = running_totals(value_counts(df, value, group), value, ["n"], group)
    totals = ranked.groupBy(*group).agg(F.sum("n").alias("__total"))
    sides = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("__total") - 1)
        sides.append(F.struct(F.lit(i).alias("i"), F.floor(at).alias("pos"), F.lit("lo").alias("side")))
        sides.append(F.struct(F.lit(i).alias("i"), F.ceil(at).alias("pos"), F.lit("hi").alias("side")))
    wanted = totals.withColumn("__wanted", F.array(*sides))
    if group:
        renamed = wanted.withColumnsRenamed({g: f"__r_{g}" for g in group})
        on = [F.col(g).eqNullSafe(F.col(f"__r_{g}")) for g in group]
        placed = ranked.join(renamed, on)
    else:
        placed = ranked.crossJoin(F.broadcast(wanted))  # one row
    start, end = F.col("before_n"), F.col("before_n") + F.col("n")
    hits = placed.select(
        *group,
        F.col(value).cast("double").alias("__v"),
        "__total",
        F.explode(F.filter("__wanted", lambda w: (w["pos"] >= start) & (w["pos"] < end))).alias("w"),
    )
    ends = hits.groupBy(*group, "w.i", "__total").agg(
        F.max(F.when(F.col("w.side") == "lo", F.col("__v"))).alias("lo"),
        F.max(F.when(F.col("w.side") == "hi", F.col("__v"))).alias("hi"),
    )
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    at = prob * (F.col("__total") - 1)
    return ends.select(
        *group, prob.alias("prob"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))).alias("quantile")
    )


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, one column `median`; NULL when there is no value."""
    return quantiles(df, value, [0.5]).agg(F.max("quantile").alias("median"))
