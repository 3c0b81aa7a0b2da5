"""Running totals over a whole column, without ever sorting it in one task.

Input is one row per (group, value) with weights, so a value held by a third of all rows is a single
row by the time it is ranked. The value axis is cut at quantiles into buckets of near-equal size: each
bucket is a window of its own, and the totals of the lower buckets (one row per bucket and group) are
added to it. The cuts are fixed numbers in the plan, so a recomputed task gets the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.sources.scratch import written

ROWS_PER_BUCKET = 20_000


def value_counts(df: DataFrame, value: str, group: Sequence[str] = (), **weights) -> DataFrame:
    """One row per (group, value) with n and any extra weights; rows without a value are left out."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*group, value).agg(F.count("*").alias("n"), *[w.alias(name) for name, w in weights.items()])


def _cuts(df: DataFrame, value: str) -> list[float]:
    """Inner bucket edges: one number per ROWS_PER_BUCKET distinct values, the only thing that reaches the driver."""
    rows = df.count()
    wanted = rows // ROWS_PER_BUCKET
    if wanted < 2:
        return []
    probes = [i / wanted for i in range(1, wanted)]
    numbers = df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", probes, 1 / (4 * wanted))
    return sorted(set(numbers))


def running_totals(
    counts: DataFrame,
    value: str,
    weights: Sequence[str],
    group: Sequence[str] = (),
    then: Sequence[str] = (),
    descending: bool = False,
    stored: bool = False,
) -> DataFrame:
    """counts plus before_<w> for each weight w: its total over the rows that sort earlier in the group.

    Rows sort by `value` and, within equal values, by the columns in `then`. `stored` says that counts is
    a table already and need not be written again.
    """
    table = counts if stored else written(counts, "counts")
    cuts = _cuts(table, value)
    axis = table.withColumn("__v", F.col(value).cast("double"))
    if cuts:
        cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__v", outputCol="__b")
        cells = cut.transform(axis).withColumn("__b", F.col("__b").cast("int"))
    else:
        cells = axis.withColumn("__b", F.lit(0))
    if descending:
        cells = cells.withColumn("__b", -F.col("__b"))
    first = F.col(value).desc() if descending else F.col(value).asc()
    earlier = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*group, "__b").orderBy(first, *then).rowsBetween(*earlier)
    inner = cells.withColumns({f"__in_{w}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    if not cuts:
        before = {f"before_{w}": F.col(f"__in_{w}") for w in weights}
        return inner.withColumns(before).drop("__v", "__b", *[f"__in_{w}" for w in weights])
    totals = cells.groupBy(*group, "__b").agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    lower = Window.partitionBy(*group).orderBy("__b").rowsBetween(*earlier)  # one row per bucket and group
    offsets = totals.select(
        *group, "__b", *[F.coalesce(F.sum(f"__t_{w}").over(lower), F.lit(0)).alias(f"__off_{w}") for w in weights]
    )
    joined = inner.join(offsets, [*group, "__b"]) if not group else _join_nullsafe(inner, offsets, [*group, "__b"])
    before = {f"before_{w}": F.col(f"__in_{w}") + F.col(f"__off_{w}") for w in weights}
    helpers = ["__v", "__b", *[f"__in_{w}" for w in weights], *[f"__off_{w}" for w in weights]]
    return joined.withColumns(before).drop(*helpers)


def _join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a NULL group matches itself."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"__r_{k}" for k in keys])


def mid_rank():
    """Average rank of a tied value, from its n and before_n."""
    return F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)


def global_rank(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """df plus `name`, its place 1..n by value; ties in the order of a hash of the key.

    A tied value is cut by the first digits of that hash into up to 4,096 cells, so even a value that
    nearly all rows share is never ranked in one task. Rows without a value get no place.
    """
    hashed = df.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__cell", F.substring("__h", 1, 3))
    cells = hashed.filter(F.col(value).isNotNull()).groupBy(value, "__cell").agg(F.count("*").alias("n"))
    placed = running_totals(cells, value, ["n"], then=["__cell"]).select(value, "__cell", "before_n")
    inside = Window.partitionBy(value, "__cell").orderBy("__h", key)
    return (
        hashed.join(placed, [value, "__cell"], "left")
        .withColumn(name, F.col("before_n") + F.row_number().over(inside))
        .drop("__h", "__cell", "before_n")
    )


def rank_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve as a rank sum; ties count half."""
    positive = F.sum(F.when(F.col(label), 1).otherwise(0))
    ranked = running_totals(value_counts(scored, score, positives=positive), score, ["n"])
    sums = ranked.agg(
        F.sum("positives").alias("p"), F.sum("n").alias("n"), F.sum(F.col("positives") * mid_rank()).alias("rank_sum")
    )
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(
        p.alias("positives"), q.alias("negatives"),
        F.try_divide(F.col("rank_sum") - p * (p + 1) / 2.0, (p * q).cast("double")).alias("roc_auc"),
    )


def average_precision(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Step sum of precision over recall gains, one step per distinct score from the top down."""
    positive = F.sum(F.when(F.col(label), 1).otherwise(0))
    ranked = running_totals(
        value_counts(scored, score, positives=positive), score, ["n", "positives"], descending=True
    )
    found = F.col("before_positives") + F.col("positives")
    flagged = F.col("before_n") + F.col("n")
    return ranked.agg(
        F.sum("positives").alias("positives"),
        F.try_divide(
            F.sum(F.col("positives") * found / flagged.cast("double")), F.sum("positives").cast("double")
        ).alias("average_precision"),
    )
