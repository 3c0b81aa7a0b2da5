"""Column helpers shared by the models. All stay in the JVM and inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the order status every revenue and customer measure is limited to.
DELIVERED = "delivered"


def timestamp_of(df: DataFrame, name: str) -> Column:
    """A timestamp column from text or from any timestamp type; unreadable text becomes NULL."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start))


def month_start(when: Column) -> Column:
    return F.trunc(F.to_date(when), "month")


def months_between_starts(later: Column, earlier: Column) -> Column:
    """Month boundaries crossed, whatever the day of the month."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def week_start(when: Column) -> Column:
    """The Sunday on or before a date."""
    day = F.to_date(when)
    return F.date_sub(day, F.dayofweek(day) - 1)


def ratio(part: Column, whole: Column) -> Column:
    """Division that gives NULL on a zero divisor."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def flag(condition: Column) -> Column:
    """True or false, never NULL."""
    return F.coalesce(condition, F.lit(False))


def one_if(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def exact_mean(value: Column) -> Column:
    """Mean over an exact decimal or integer sum, so that the order of rows cannot change it."""
    return ratio(F.sum(value), F.count(value))


def surrogate_key(*parts: Column) -> Column:
    """md5 of the parts joined by a bar; NULL as soon as one part is NULL."""
    joined = []
    for part in parts:
        joined += [F.lit("|"), part.cast("string")]
    return F.md5(F.concat(*joined[1:]))


def keyed_order(seed: int, key: Column) -> Column:
    """A repeatable pseudo-random sort key."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def even_ties(value: Column, digits: int) -> Column:
    """value, made ready for "%.<digits>f": the format rounds exact ties up, these go to the even digit."""
    tie = F.pmod(F.abs(value) * 2 ** (digits + 1), F.lit(2.0)) == 1  # an exact tie is an odd multiple of 2^-(digits+1)
    return F.when(tie, F.bround(value, digits)).otherwise(value)


def doubles(df: DataFrame) -> DataFrame:
    """Decimals to doubles: the last step of a query, after all exact sums."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
