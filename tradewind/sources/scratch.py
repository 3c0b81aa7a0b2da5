"""Intermediate tables in the folder all executors share.

Operators that read an intermediate result more than once write it here as Parquet: it is computed
once, survives the loss of executors, cuts the lineage, and later reads are column-pruned.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a folder of our own only where one machine does all the work."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(
            f"set spark.checkpoint.dir to a folder that the driver and all executors share (master is {master!r})"
        )
    own = getattr(spark, "_tradewind_scratch", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tradewind-")
        spark._tradewind_scratch = own
    return own


def session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tradewind-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back with its own schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_RELEASES: dict[str, int] = {}


def generation(spark: SparkSession) -> int:
    """How often the session's scratch tables have been deleted: what is kept between calls must match it."""
    return _RELEASES.get(spark.sparkContext.applicationId, 0)


def release(spark: SparkSession) -> bool:
    """Delete what this session has written; call when its results have been read."""
    _RELEASES[spark.sparkContext.applicationId] = generation(spark) + 1
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(path, True)
