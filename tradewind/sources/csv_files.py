"""Raw CSV files with fixed schemas, landed once as Parquet."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.schemas import BRONZE
from tradewind.sources.bronze import Bronze

CORRUPT = "_corrupt_record"

# Tables whose text columns hold line breaks inside quotes. Such a file cannot be split, so it is read
# by one task per file; everything after the landing reads Parquet.
MULTI_LINE = frozenset({"order_reviews"})


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A file (or folder of files) of a known table; the raw text of an unreadable row is in _corrupt_record."""
    schema = T.StructType([*BRONZE[table].fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", table in MULTI_LINE).option("quote", '"').option("escape", '"')
        .csv(path)
    )


def good_rows(raw: DataFrame) -> DataFrame:
    return raw.filter(raw[CORRUPT].isNull()).drop(CORRUPT)




def land(spark: SparkSession, paths: Mapping[str, str], target: str) -> Bronze:
    """Load each table's CSV in full over its Parquet copy below `target`; unreadable rows beside it."""
    tables = {}
    for table, path in paths.items():
        raw = read_csv(spark, path, table)
        good_rows(raw).write.mode("overwrite").parquet(f"{target}/{table}")
        # A file source does not scan for the corrupt column alone, so the whole row is selected first.
        raw.filter(raw[CORRUPT].isNotNull()).write.mode("overwrite").parquet(f"{target}/{table}_rejected")
        tables[table] = spark.read.schema(BRONZE[table]).parquet(f"{target}/{table}")
    return Bronze(**tables)


def landed_counts(spark: SparkSession, target: str) -> DataFrame:
    """table_name, rows, rejected: what land() wrote below `target`."""
    counts = [
        spark.read.schema(BRONZE[t]).parquet(f"{target}/{t}").agg(F.count("*").alias("rows"))
        .crossJoin(spark.read.parquet(f"{target}/{t}_rejected").agg(F.count("*").alias("rejected")))  # one row each
        .select(F.lit(t).alias("table_name"), "rows", "rejected")
        for t in Bronze.names()
    ]
    return reduce(DataFrame.unionAll, counts)


def bronze_from(spark: SparkSession, target: str) -> Bronze:
    """The landed tables."""
    return Bronze(**{t: spark.read.schema(BRONZE[t]).parquet(f"{target}/{t}") for t in Bronze.names()})
