"""Token ids as Parquet list columns, in ascending order of document ids.

Texts are dealt out by ranges of ids once, encoded where they land and written by Spark's Parquet
writer: dictionary pages for the ids (delta encoding where a dictionary grows too large), row groups
of ROW_GROUP bytes and pages of PAGE bytes with column indexes. A reader that asks for some documents
therefore opens the row groups and pages that hold their ids, and one that asks for lengths alone
does not touch the token column.

Null texts are empty, and every document ends with the end id. Rows that share an id stand in the
order of their texts. A null id stands first. A text of any length is encoded whole and lies in one row group. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm import common
from tradewind.llm.tokens import WORD_BPE, library, vocabulary_path
from tradewind.sources import scratch

END_ID = 2
ROW_GROUP = 32 << 20
PAGE = 256 << 10
#: Bytes of text whose distinct words are looked up together.
SLICE = 4 << 20
#: Text of a file, about: larger tables get more files.
FILE_BYTES = 1 << 30


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids of docs in the partitions and order they have."""
    schema = T.StructType.fromDDL(f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids array<int>")
    target = common.to_arrow(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                starts, ids = library(path).many(part.column("text"))
                offsets = starts + np.arange(len(starts), dtype=np.int32)
                ended = np.insert(ids, starts[1:], end_id).view("<i4")
                columns = (part.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(offsets, ended))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, target)], schema=target)

    return docs.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE bytes of text or less, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if a < b:
            yield batch.slice(a, b - a)


def write(docs: DataFrame, target: str, path: str, files: int | None = None) -> None:
    """Encode docs and write files in ascending order of doc_id; column file numbers them in that order.

    Unless files says how many, a file holds about FILE_BYTES of text, and every task writes one.
    """
    narrow = common.renamed_clear(docs, ("doc_id", "text"))
    if files is None:
        size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        files = max(common.shuffle_tasks(docs.sparkSession), math.ceil(size / FILE_BYTES))
    # Rows of one id are told apart by their texts, so that a repeated id can be cut.
    ordered = (
        narrow.repartitionByRange(files, "doc_id", F.substring("text", 1, 32))
        .sortWithinPartitions("doc_id", "text")
    )
    (
        encoded(ordered, path)
        .withColumns({"file": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
        .write.option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.enable.dictionary", True)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("compression", "zstd")
        .parquet(target)
    )


def read(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Without ids, only metadata is read.

    Running totals stay inside a file; what comes before a file is summed over one row per file.
    """
    rows = spark.read.parquet(target)
    ordered = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__inside", F.coalesce(F.sum("n_tokens").over(ordered), F.lit(0)))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("__n"))
    so_far = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__start"))
    return inside.join(F.broadcast(starts), "file").select(
        *[c for c in rows.columns if c not in ("file", "place")],
        (F.col("__start") + F.col("__inside")).cast("bigint").alias("start"),
    )


def checksums(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of everything in the files; the ids never leave their task."""
    rows = spark.read.parquet(target)
    schema = T.StructType([*[f for f in rows.schema if f.name != "ids"], T.StructField("ids_crc32", T.LongType())])
    target_schema = common.to_arrow(schema)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            kept = [batch.column(f.name).cast(f.type) for f in target_schema if f.name != "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], schema=target_schema)

    path = scratch.new_path(spark, "token-checksums")
    rows.mapInArrow(run, schema).write.parquet(path)
    return read(spark, path)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    target = scratch.new_path(spark, "token-files")
    write(docs, target, vocabulary_path(WORD_BPE))
    return checksums(spark, target).select("doc_id", "start", "n_tokens", "ids_crc32")
