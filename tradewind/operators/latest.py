"""One row per key: the one that sorts last.

Written as an aggregate, so that each task first reduces its own rows (a hot key never travels whole)
and Catalyst knows the result is unique on the key and can drop a left join nobody reads from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """NULLs in the order columns sort before every value."""
    last = F.max_by(F.struct(*payload), F.struct(*order)).alias("last")
    return df.groupBy(key).agg(last).select(key, "last.*")
