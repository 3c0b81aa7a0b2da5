"""What the operators of this folder share: reading tables, Arrow maps over documents, hashing words."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.session import tune

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of an Arrow batch: with documents of a few kB, some MB at a time in a Python worker.
BATCH_ROWS = 2_000

MIX = np.uint64(0x9E3779B97F4A7C15)


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on; Python workers also find this package."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark


_LARGE: list[dict] = []


def claim(cache: dict) -> None:
    """Called by an operator whose cache may take much of a worker: a worker keeps only the cache last claimed.

    Workers live on from stage to stage, so the caches of a pipeline's stages would add up.
    """
    if _LARGE and _LARGE[0] is not cache:
        _LARGE[0].clear()
    _LARGE[:] = [cache]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, Iterable]], schema: str) -> DataFrame:
    """Map whole batches: rows gets Python columns by name and returns the columns of schema by name."""
    struct = T.StructType.fromDDL(schema)
    target = to_arrow(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([column(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, struct)


def column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def to_arrow(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text in UTF-8; bytes.split() cuts at just these characters."""
    return text.encode().split() if text else []


def word_hashes(found: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in found), np.uint64, len(found))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """One mixed 64-bit hash for every run of size consecutive hashes (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * MIX + hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def renamed_clear(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra columns of the input cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in keep])
