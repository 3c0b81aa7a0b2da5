"""Writers: full rebuild of a table, with a declared schema for the tables the model jobs own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.schemas import SCORED


def fit_schema(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the declared columns and types of a scored table; a missing column fails here."""
    declared = SCORED[table]
    missing = [f.name for f in declared.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared.fields])


def replace_table(df: DataFrame, name: str, partition_by: str | None = None) -> None:
    """Rebuild a table in full. Never called on a table that df itself reads.

    A partitioned table is rebalanced first: adaptive execution then splits a partition value that
    holds much of the data over several tasks and merges the small ones, one file or a few each.
    """
    writer = df.hint("rebalance", partition_by).write if partition_by else df.write
    writer = writer.mode("overwrite").format("parquet")
    (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(name)


def write_scored(df: DataFrame, table: str, database: str = "gold") -> None:
    replace_table(fit_schema(df, table), f"{database}.{table}")


def table_exists(spark: SparkSession, database: str, table: str) -> bool:
    return spark.catalog.tableExists(f"{database}.{table}")


def read_if_exists(spark: SparkSession, database: str, table: str) -> DataFrame | None:
    """The table, or None when the job that writes it has not run yet."""
    return spark.table(f"{database}.{table}") if table_exists(spark, database, table) else None
