"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths).
All three demands of a piece follow from its length, so pieces of a length are alike, and packing the
histogram of lengths (at most one row per possible length, however many documents there are) packs
them all. Lengths are taken in falling order. Bins with the same residual vector form a class; a length
goes to the class with the smallest weighted norm of what would remain, among those where it fits in
every dimension, else to new bins. The outcome is a list of segments: "of this length, the pieces
with ranks r to s lie in bins b onward, at this offset". Pieces are then ranked within their length,
in hashed parts so that a very common length is spread over tasks, and look up their segment.

Null texts are empty documents, which still have their end id. Pieces of repeated document ids are
ranked like any others. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm import common
from tradewind.llm.tokens import BYTE_BPE, library, vocabulary_path
from tradewind.sources import scratch

END_ID = 0


@dataclass(frozen=True)
class Capacities:
    """Of a sequence. The defaults for documents and cost admit whatever the tokens admit."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    #: Weights of the residual norm, for tokens, documents and cost.
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01)


def pieces(docs: DataFrame, path: str, size: int, with_ids: bool = False, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document with its end id, long ones cut.

    Only documents of more than size tokens are cut; of their pieces, the first is the short one.
    """
    end = np.array([end_id], "<u4").tobytes()

    def rows(batch: dict) -> dict:
        tokens = library(path)
        out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            packed = tokens.packed(text) + end
            n = len(packed) // 4
            cuts = [0, *range(n % size or size, n, size), n]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                own = packed[4 * a : 4 * b]
                for name, value in zip(out, (doc_id, i, a, b - a, zlib.crc32(own))):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(np.frombuffer(own, "<i4"))
        return out

    narrow = common.renamed_clear(docs, ("doc_id", "text"))
    kind = dict(narrow.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return common.arrow_map(narrow, rows, schema + (", ids array<int>" if with_ids else ""))


def packed_histogram(counts: dict[int, int], caps: Capacities) -> np.ndarray:
    """Segments (length, first rank, pieces, pieces a bin, first bin, offset), sorted by length and rank."""
    limit = np.array([caps.tokens, caps.documents, caps.cost], float)
    weights = np.array(caps.weights)
    left = np.empty((1024, 3))  # residual vectors of the classes
    first, bins = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    n_classes, n_bins = 0, 0
    segments = []

    def add(residual, first_bin, how_many):
        nonlocal left, first, bins, n_classes
        if n_classes == len(left):
            left = np.concatenate([left, np.empty_like(left)])
            first, bins = np.concatenate([first, first * 0]), np.concatenate([bins, bins * 0])
        left[n_classes], first[n_classes], bins[n_classes] = residual, first_bin, how_many
        n_classes += 1

    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], float)
        if (demand > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rank, todo = 0, counts[length]
        while todo:
            fits = np.flatnonzero((left[:n_classes] >= demand).all(axis=1) & (bins[:n_classes] > 0))
            if len(fits):
                norms = (((left[fits] - demand) / limit) ** 2) @ weights
                chosen = int(fits[np.argmin(norms)])
                residual, at, available = left[chosen].copy(), int(first[chosen]), int(bins[chosen])
            else:
                residual, at, available = limit.copy(), n_bins, todo
            each = int(np.floor(residual / demand).min())
            each = min(each, todo)
            used = min(available, todo // each)
            taken = used * each
            segments.append((length, rank, taken, each, at, int(limit[0] - residual[0])))
            if len(fits):
                first[chosen], bins[chosen] = at + used, available - used
            else:
                n_bins += used
            add(residual - each * demand, at, used)
            rank, todo = rank + taken, todo - taken
        if n_classes > 4096:  # drop classes that are used up
            alive = np.flatnonzero((bins[:n_classes] > 0) & (left[:n_classes, 0] > 0))
            left[: len(alive)], first[: len(alive)], bins[: len(alive)] = left[alive], first[alive], bins[alive]
            n_classes = len(alive)
    return np.array(sorted(segments), np.int64).reshape(-1, 6)


def packed(cut: DataFrame, caps: Capacities = Capacities()) -> DataFrame:
    """cut (a stored table with doc_id, piece, length) with sequence_id and offset."""
    spark = cut.sparkSession
    rows = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most one row per length
    plan = packed_histogram({r["length"]: r["n"] for r in rows}, caps)

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(common.shuffle_tasks(spark)))
    spread = cut.withColumn("__part", part)
    counts = spread.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__part").orderBy("doc_id", "piece")
    ranked = (
        spread.withColumn("__own", F.row_number().over(own) - 1)
        .join(before, ["length", "__part"])
        .withColumn("__rank", F.col("__own") + F.col("__before"))
        .select(*cut.columns, "__rank")
    )
    return _placed(ranked, plan, cut.columns)


def _placed(ranked: DataFrame, plan: np.ndarray, columns: list[str]) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql import types as T

    spark = ranked.sparkSession
    shared = spark.sparkContext.broadcast(plan)  # some segments per possible length
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*[ranked.schema[c] for c in columns], *added])
    target = common.to_arrow(schema)

    def run(batches):
        segments = shared.value
        keys = (segments[:, 0] << 48) + segments[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("__rank").to_numpy().astype(np.int64)
            found = segments[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            place = rank - found[:, 1]
            sequence = found[:, 4] + place // found[:, 3]
            offset = found[:, 5] + place % found[:, 3] * length
            kept = [batch.column(c).cast(target.field(c).type) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=target)

    return ranked.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and the token ids of each sequence, from pieces packed with their ids."""
    lists = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return placed.groupBy("sequence_id").agg(F.flatten(lists).alias("ids"))  # bounded by the capacity


def packed_documents(docs: DataFrame, path: str, caps: Capacities = Capacities()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents."""
    return packed(scratch.written(pieces(docs, path, caps.tokens), "pieces"), caps)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return packed_documents(docs, vocabulary_path(BYTE_BPE))
