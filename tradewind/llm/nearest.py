"""Approximate nearest neighbours by inner product: inverted lists, scanned dimension block by block.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2), which gives
all vectors the length M of the longest (Shrivastava and Li). Vectors are put into LISTS lists by
k-means centres, fitted on at most SAMPLE rows chosen by a hash of their id; every row is put into a
list. A query visits the PROBED share of lists whose centres are nearest.

Within a list, vectors are rotated at random and kept as blocks of COLUMNS coordinates. After each
block a test asks whether the distance seen so far, scaled up, exceeds the k-th best by more than a
random rotation can explain, (1 + EPSILON / sqrt(m))^2; candidates that fail are abandoned there and
later blocks are read for the rest only (adaptive dimension scan, after Gao and Long, "ADSampling").
Finalists are scored on their original values in double precision, added from the first coordinate to
the last.

Lists are cut into chunks of CHUNK vectors and queries into blocks of QUERY_BLOCK, so a list that holds
a third of all rows is many units of work. Of equal vectors only the k + 1 smallest ids can be among
the k nearest of any query, and equal queries are searched once.

Vectors that are null, zero, of another length than most sampled ones, or hold null or non-finite components take no part;
rows without an id neither. Queries with fewer than k candidates found return those. Rows that repeat
an id are candidates each, but never for a query of the same id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm import common
from tradewind.sources import scratch

LISTS = 32
SAMPLE = 20_000
#: Sampled rows that a list should have at least; small tables get fewer lists.
ROWS_A_LIST = 250
PROBED = 0.9
EPSILON = 2.1
COLUMNS = 16
ROWS = 1_024
CHUNK = 4_096
QUERY_BLOCK = 65_536
SEED = 11


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double or float) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return common.renamed_clear(vectors, ("vec_id", "embedding")).filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True))
    ).filter(F.exists("embedding", lambda x: x != 0))


def _values(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Index:
    """Rotation, centres and the longest norm: all a task needs to place, rotate and compare."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.longest, self.size = longest, sample.shape[1] + 1
        self.rotation = np.linalg.qr(random.standard_normal((self.size, self.size)))[0]
        own = self.rotated(sample)
        centres = own[random.choice(len(own), lists, replace=False)]
        for _ in range(15):
            near = self.distances(own, centres).argmin(axis=1)
            counts = np.bincount(near, minlength=lists)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, own)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        self.centres = centres

    def rotated(self, values: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(values)) if query else np.sqrt(
            np.maximum(0.0, self.longest**2 - np.einsum("ij,ij->i", values, values))
        )
        return np.c_[values, rest] @ self.rotation

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def scan(query: np.ndarray, blocks: list[np.ndarray], k: int, epsilon: float) -> np.ndarray:
    """Places of the candidates that no test has abandoned and that are among the k nearest (and ties)."""
    n, size = len(blocks[0]), len(query)
    parts = np.split(query, np.cumsum([b.shape[1] for b in blocks])[:-1])
    kept, distance, worst = np.empty(0, np.int64), np.empty(0), np.inf
    for at in range(0, n, ROWS):
        alive = np.arange(at, min(at + ROWS, n))
        so_far, seen = np.zeros(len(alive)), 0
        for own, block in zip(parts, blocks):
            rest = block[alive] - own
            so_far += np.einsum("ij,ij->i", rest, rest)
            seen += len(own)
            if worst < np.inf:
                slack = (1 + epsilon / math.sqrt(seen)) ** 2 * seen / size if seen < size else 1 + 1e-9
                near = so_far <= slack * worst
                alive, so_far = alive[near], so_far[near]
        kept, distance = np.r_[kept, alive], np.r_[distance, so_far]
        if len(kept) > k:
            worst = np.partition(distance, k - 1)[k - 1]
            near = distance <= worst * (1 + 1e-9)
            kept, distance = kept[near], distance[near]
    return kept


def exact_scores(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products added from the first coordinate to the last, whatever else is in the batch."""
    out = np.zeros(len(candidates))
    for i, x in enumerate(query):
        out += x * candidates[:, i]
    return out


def _search(index: Index, k: int, epsilon: float):
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not (candidates.num_rows and queries.num_rows):
            return schema.empty_table()
        ids = candidates.column("vec_id").to_numpy()
        values, wanted = _values(candidates.column("embedding")), _values(queries.column("embedding"))
        rotated = index.rotated(values)
        blocks = [np.ascontiguousarray(rotated[:, i : i + COLUMNS]) for i in range(0, index.size, COLUMNS)]
        found = []
        for name, query, turned in zip(
            queries.column("query").to_numpy(), wanted, index.rotated(wanted, query=True)
        ):
            near = scan(turned, blocks, k, epsilon)
            scores = exact_scores(query, values[near])
            best = np.lexsort((ids[near], -scores))[:k]
            found.append((np.full(len(best), name), ids[near][best], scores[best]))
        return pa.table([np.concatenate(x) for x in zip(*found)], schema=schema)

    return run


def fitted(vectors: DataFrame, lists: int = LISTS) -> Index | None:
    """The index over a bounded sample and the largest norm of all rows; None for an empty table."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE).collect()
    if not rows:
        return None
    lengths = np.array([len(r[0]) for r in rows])
    size = int(np.bincount(lengths).argmax())
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = vectors.filter(F.size("embedding") == size).agg(F.max(square)).first()[0]
    sample = np.array([r[0] for r in rows if len(r[0]) == size], float)
    return Index(sample, math.sqrt(longest), max(1, min(lists, len(sample) // ROWS_A_LIST)))


def _listed(vectors: DataFrame, index: Index, near: int, query: bool) -> DataFrame:
    """vectors with lists, the near nearest ones first."""
    from pyspark.sql import types as T

    schema = T.StructType([*vectors.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    target = common.to_arrow(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                turned = index.rotated(_values(batch.column("embedding")), query)
                order = np.argsort(index.distances(turned, index.centres), axis=1, kind="stable")[:, :near]
                same = [batch.column(f.name).cast(f.type) for f in target if f.name != "lists"]
                lists = pa.array(list(order.astype(np.int32)), target.field("lists").type)
                yield pa.RecordBatch.from_arrays([*same, lists], schema=target)

    return vectors.mapInArrow(run, schema)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, probed: float = PROBED, epsilon: float = EPSILON, lists: int = LISTS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for each query row.

    vectors, queries: vec_id bigint, embedding array; a row is no candidate for a query of its own id.
    """
    spark = vectors.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    own = scratch.written(valid(vectors), "vectors")
    index = fitted(own, lists)
    if index is None:
        return spark.createDataFrame([], empty)
    size = index.size - 1
    # Of equal vectors, the k + 1 smallest ids; Spark cuts them in each task before the shuffle.
    same = Window.partitionBy("embedding").orderBy("vec_id")
    candidates = own.filter(F.size("embedding") == size).withColumn("__n", F.row_number().over(same))
    candidates = candidates.filter(F.col("__n") <= k + 1).drop("__n")
    placed = scratch.written(
        _listed(candidates, index, 1, False).withColumn("list", F.col("lists")[0]).drop("lists"), "placed-vectors"
    )
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows
    chunks = [math.ceil(sizes.get(i, 0) / CHUNK) for i in range(len(index.centres))]
    chunk_count = F.array(*[F.lit(c) for c in chunks])[F.col("list")]

    asked = valid(queries).filter(F.size("embedding") == size)
    classes = asked.groupBy("embedding").agg(F.min("vec_id").alias("query"))
    asked = scratch.written(asked.join(classes, "embedding").select("vec_id", "embedding", "query"), "queries")
    distinct = asked.filter("vec_id = query").select("query", "embedding").dropDuplicates(["query"])
    block_count = max(1, math.ceil(asked.agg(F.count("*")).first()[0] / QUERY_BLOCK))

    visits = max(1, math.ceil(probed * len(index.centres)))
    keys = ["list", "chunk", "block"]
    sent = (
        _listed(distinct, index, visits, True)
        .withColumn("block", F.pmod(F.xxhash64("query"), F.lit(block_count)))
        .withColumn("list", F.explode("lists"))
        .filter(chunk_count > 0)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), (chunk_count - 1).cast("bigint"))))
        .drop("lists")
    )
    held = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunk_count)).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(block_count - 1).cast("bigint")))
    )
    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(
        _search(index, k + 1, epsilon), "query bigint, vec_id bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k + 1).drop("__n")
    each = asked.select(F.col("vec_id").alias("query_id"), "query").distinct().join(top, "query")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        each.filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)
