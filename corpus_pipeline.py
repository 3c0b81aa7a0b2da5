"""A corpus of documents cleaned and packed, one stored stage after another.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the docs of the next. All but the last return the columns of
documents. run() applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import common, packing, quality, secrets, simhash, substring
from tradewind.llm.tokens import BYTE_BPE, vocabulary_path
from tradewind.sources import scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    common.prepared(spark)
    return quality.filtered(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints linked at 2 or fewer differing bits (3-word shingles), the document with the smallest id.

    Documents without an id stay.
    """
    common.prepared(spark)
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the word sequences that an earlier document holds too."""
    common.prepared(spark)
    return substring.deduplicated(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark."""
    common.prepared(spark)
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed into sequences."""
    common.prepared(spark)
    return packing.packed_documents(docs, vocabulary_path(BYTE_BPE))


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

# Components of fingerprints, spans tagged by a model and tokenizers are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
