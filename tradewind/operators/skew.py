"""A join of many rows to a table that has one row per key, when one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """facts joined to lookup (unique on key, left or inner), fit for hot and NULL keys of facts.

    Adaptive execution splits a hot partition of facts over many tasks, but only if both inputs of the
    join come straight out of a shuffle. A lookup that ends in an aggregate by the same key would not,
    so it is rebalanced first: the join then shuffles it by key itself. A lookup that turns out to be
    small is broadcast instead, by the size the shuffle has measured.
    """
    return facts.join(lookup.hint("rebalance"), key, how)
