"""A repeatable random sample of a fixed size per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.scalars import keyed_order
from tradewind.operators.ranking import running_totals, value_counts


def keyed_sample(
    df: DataFrame, n: int, by: Sequence[str], key: str, seed: int, rank: str | None = None
) -> DataFrame:
    """The n rows of each group whose keyed hash is smallest; ties by key. `rank` keeps the place 1..n.

    Up to the window-group-limit threshold (1,000 by default) each task keeps n rows per group before
    the shuffle, so a hot group never travels whole. A larger n ranks by hash cells instead.
    """
    name = rank or "__rn"
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    hashed = df.withColumn("__h", keyed_order(seed, F.col(key)))
    if n <= limit:
        order = Window.partitionBy(*by).orderBy("__h", key)
        sampled = hashed.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n).drop("__h")
        return sampled if rank else sampled.drop(name)
    # The first digits of the hash cut a group into 65,536 cells; only cells that start within the
    # first n rows are kept, and places inside a cell are counted on from where it starts.
    celled = hashed.withColumn("__cell", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    starts = running_totals(value_counts(celled, "__cell", by), "__cell", ["n"], by).filter(F.col("before_n") < n)
    renamed = starts.select(*[F.col(c).alias(f"__r_{c}") for c in [*by, "__cell"]], "before_n")
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in [*by, "__cell"]]
    inside = Window.partitionBy(*by, "__cell").orderBy("__h", key)
    sampled = (
        celled.join(renamed, on)
        .withColumn(name, (F.col("before_n") + F.row_number().over(inside)).cast("int"))
        .filter(F.col(name) <= n)
        .drop("__h", "__cell", "before_n", *[f"__r_{c}" for c in [*by, "__cell"]])
    )
    return sampled if rank else sampled.drop(name)
