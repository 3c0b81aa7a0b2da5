"""Histogram sort into shards of near-equal bytes, with DataFrame operations only.

Rows are ordered by a key. Candidate boundaries (probes) are laid through the key range and one
aggregate counts the exact bytes below each; the probes around every wanted boundary are then laid
anew between the two neighbours that enclose it, until the bytes below a probe are within the
tolerance of the wanted number or no key lies between the neighbours (after Solomonik and Kale's
histogram sort). Only probe counts reach the driver: PROBES numbers per boundary and round. Then the
rows are exchanged once, into the final ranges.

A shard is made of PARTS consecutive ranges, or of as many more as keep a range below RANGE_BYTES, so a
shard is written by many tasks and a task's share does not grow with the table. A row's slot is the
number of rows in earlier ranges of its shard plus its place in its own range. Rows of equal keys
cannot be told apart by a boundary and share a shard; a null key sorts first.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm import common
from tradewind.sources import scratch

SHARDS = 8
#: Ranges that make up one shard, at least.
PARTS = 8
#: Bytes of a range at most, but for the tolerance and for rows of one key: larger tables get more ranges.
RANGE_BYTES = 4 << 30
#: Boundaries may be off by this share of a range's bytes.
TOLERANCE = 0.002
PROBES = 15
LEAST = -(2**63)


def _array(values: Sequence[int]) -> Column:
    """The sorted numbers as one array constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def place(key: Column, edges: Sequence[int]) -> Column:
    """How many of the sorted edges are at most key, by halving steps: as many as an edge number has bits."""
    steps = [1 << i for i in reversed(range(len(edges).bit_length()))]
    # Filled up to 2^n - 1 edges, so that every step may look; what fills counts as above every key.
    filled = F.concat(_array(edges), F.array_repeat(F.lit(None).cast("bigint"), sum(steps) - len(edges)))
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]) if steps else F.array().cast("array<int>"),
        F.lit(0),
        lambda acc, step: acc + F.when(F.element_at(filled, acc + step) <= key, step).otherwise(0),
    )


def below(rows: DataFrame, probes: Sequence[int]) -> list[int]:
    """Exact bytes of the rows with a key below each probe, in one pass with map-side sums."""
    edges = sorted(set(probes))
    found = rows.groupBy(place(F.col("__key"), edges).alias("place")).agg(F.sum("__size").alias("bytes")).collect()
    sums = {r["place"]: int(r["bytes"]) for r in found}  # a row per probe
    out, total = {}, 0
    for i, edge in enumerate(edges):
        total += sums.get(i, 0)
        out[edge] = total
    return [out[x] for x in probes]


def splitters(rows: DataFrame, shards: int, parts: int | None = None) -> tuple[list[int], int]:
    """The first keys of all ranges but the first, such that ranges hold near-equal bytes; ranges of a shard."""
    ends = rows.agg(F.min("__key").alias("a"), F.max("__key").alias("b"), F.sum("__size").alias("total")).first()
    total = int(ends["total"] or 0)
    parts = parts or max(PARTS, -(-total // (shards * RANGE_BYTES)))
    if not total:
        return [], parts
    ranges = shards * parts
    wanted = [total * i / ranges for i in range(1, ranges)]
    slack = TOLERANCE * total / ranges
    # For each boundary: (key, bytes below it) on either side of it.
    spans = [((ends["a"], 0), (min(ends["b"] + 1, 2**63 - 1), total)) for _ in wanted]
    while True:
        open_ = [i for i, (lo, hi) in enumerate(spans) if hi[0] - lo[0] > 1 and _nearest(lo, hi, wanted[i])[1] > slack]
        if not open_:
            return sorted(_nearest(lo, hi, w)[0] for (lo, hi), w in zip(spans, wanted)), parts
        probes = sorted({p for i in open_ for p in _between(spans[i][0][0], spans[i][1][0])})
        counts = below(rows, probes)
        for i in open_:
            after = bisect_right(counts, wanted[i])  # the first probe with more bytes below it than wanted
            near = [(probes[j], counts[j]) for j in (after - 1, after) if 0 <= j < len(probes)]
            lo, hi = spans[i]
            lower, upper = ([x for x in near if (x[1] <= wanted[i]) == side] for side in (True, False))
            spans[i] = max([lo, *lower]), min([hi, *upper])


def _nearest(lo, hi, wanted) -> tuple[int, float]:
    return min(((key, abs(bytes_ - wanted)) for key, bytes_ in (lo, hi)), key=lambda x: x[1])


def _between(low: int, high: int) -> list[int]:
    step = max(1, (high - low) // (PROBES + 1))
    return [x for x in range(low + step, high, step)][:PROBES]


def sharded(df: DataFrame, key: Column, size: Column, shards: int = SHARDS, parts: int | None = None) -> DataFrame:
    """df with size, shard (int) and slot (long); key must be a bigint column, size a bigint >= 0.

    parts: ranges of a shard, from the bytes if not given.
    Equal slots of repeated keys are broken arbitrarily. An empty table stays empty.
    """
    spark = df.sparkSession
    keyed = df.withColumns({"__key": F.coalesce(key.cast("bigint"), F.lit(LEAST)), "__size": size})
    counted = scratch.written(keyed.select("__key", "__size"), "shard-keys")
    cuts, parts = splitters(counted, shards, parts)
    part = place(F.col("__key"), cuts)

    totals = counted.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(_window("__shard", "__part")) - F.col("n")
    starts = totals.withColumn("__shard", F.floor(F.col("__part") / parts)).select("__part", before.alias("__start"))

    # The one exchange: a window needs the rows of a range together, in order of their keys.
    ranged = keyed.withColumn("__part", part)
    slot = F.row_number().over(_window("__part", "__key")) - 1
    return (
        ranged.withColumn("__slot", slot)
        .join(F.broadcast(starts), "__part")  # a row per range
        .withColumns(
            {
                "size": F.col("__size"),
                "shard": F.floor(F.col("__part") / parts).cast("int"),
                "slot": (F.col("__start") + F.col("__slot")).cast("bigint"),
            }
        )
        .drop("__key", "__size", "__part", "__slot", "__start")
    )


def _window(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


def op10_histogram_sort(spark, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.crc32(text).alias("text_crc32")
    )
    return sharded(docs, F.col("doc_id"), F.col("n_bytes") + 1).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
