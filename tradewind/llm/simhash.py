"""SimHash near-duplicates found by anchor points of a covering code.

The 64 bits of a fingerprint are read as two blocks of 23 and 18 free bits. The anchors are the pairs of
words of the perfect binary Golay code on the two blocks: every block lies within 3 bits of just one
code word, so every fingerprint has one home anchor. If two fingerprints differ in at most LIMIT bits, e1
of them in the first block and e2 in the second, then the first lies within 3 + e1 and 3 + e2 bits of
the home of the other. So a fingerprint is replicated to all anchors within 3 + e1 and 3 + e2 bits
with e1 + e2 <= LIMIT, about 61 of 2**24 for a limit of 2, and every anchor compares those that live
there with all that were sent there. No link can be missed.

Only distinct fingerprints are replicated. An anchor gives a tree of links, not its pairs. At an
anchor with more than BUCKET fingerprints none are compared in place: they go to the flipped-bit join
instead, where two fingerprints within 2 bits meet at a value within 1 bit of both (at most 65 meet at
one value). Groups are then joined into components.

Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat an id keep
their fingerprints, one row each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm import common
from tradewind.llm.components import components
from tradewind.sources import scratch

SHINGLE = 3
SEED = 42
LIMIT = 2
BUCKET = 4_096
BLOCK = 23
CHUNK = 1 << 16

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, A-Z in lower case."""
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    if len(found) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        own = zip(*[found[i:] for i in range(shingle)])
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in own]
    bits = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), CHUNK):
        counts += np.unpackbits(bits[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def rows(batch: dict) -> dict:
        own = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
        return {"doc_id": batch["doc_id"], "fingerprint": own.view(np.int64)}

    narrow = common.renamed_clear(docs, ("doc_id", "text"))
    return common.arrow_map(narrow, rows, f"doc_id {dict(narrow.dtypes)['doc_id']}, fingerprint bigint")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words divided by the generator: 0 for code words, else the coset."""
    rest = words.copy()
    for bit in range(BLOCK - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - 11), rest)
    return rest


@cache
def cosets(limit: int) -> list[list[np.ndarray]]:
    """For every syndrome and e up to limit: the words of that coset that have weight 3 + e (3 or less for 0)."""
    words = [np.zeros(1, np.int64)]
    last = words[0]
    for _ in range(3 + limit):
        # add a bit above the highest one set, so that each word is made once
        grown = [last[last < 1 << bit] | 1 << bit for bit in range(BLOCK)]
        last = np.concatenate(grown)
        words.append(last)
    out: list[list[np.ndarray]] = [[] for _ in range(1 << 11)]
    for own in [np.concatenate(words[:4]), *words[4:]]:
        syndrome = syndromes(own)
        order = np.argsort(syndrome, kind="stable")
        cuts = np.searchsorted(syndrome[order], np.arange(1, 1 << 11))
        for coset, members in zip(out, np.split(own[order], cuts)):
            coset.append(members)
    return out


def anchors(value: int, limit: int) -> np.ndarray:
    """The anchors of a fingerprint, its home first."""
    table = cosets(limit)
    first, second = value >> 41 & 0x7FFFFF, value >> 18 & 0x7FFFFF
    one, two = (table[int(syndromes(np.array([x]))[0])] for x in (first, second))
    found = [
        (first ^ one[e1])[:, None] << BLOCK | (second ^ two[e2])[None, :]
        for e1 in range(limit + 1)
        for e2 in range(limit + 1 - e1)
    ]
    return np.concatenate([x.ravel() for x in found])


def _replicate(limit: int):
    schema = pa.schema([("anchor", pa.int64()), ("fingerprint", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fingerprint").to_numpy()
            for at in range(0, len(own), 1_000):
                part = own[at : at + 1_000]
                found = [anchors(int(x) & (1 << 64) - 1, limit) for x in part]
                sizes = np.array([len(x) for x in found])
                home = np.zeros(sizes.sum(), bool)
                home[np.cumsum(sizes) - sizes] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), pa.array(np.repeat(part, sizes)), pa.array(home)], schema=schema
                )

    return run


def tree(values: np.ndarray, home: np.ndarray, limit: int) -> np.ndarray:
    """Links (a, b) that join each group of values within limit bits of a home value, a row each."""
    label = np.arange(len(values))
    for i in np.flatnonzero(home):
        near = np.bitwise_count(values ^ values[i]) <= limit
        groups = np.unique(label[near])
        if len(groups) > 1:
            label[np.isin(label, groups)] = groups[0]
    moved = label != np.arange(len(values))
    return np.stack([values[moved], values[label[moved]]], axis=1)


def _compare(limit: int, bucket: int):
    """Over rows sorted by anchor: links, and as rows with b null the members of anchors too full to compare."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(anchor, value, home):
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[starts, len(anchor)])
        for start, size in zip(starts[sizes > 1], sizes[sizes > 1]):
            own = slice(start, start + size)
            if home[own].any():
                yield tree(value[own], home[own], limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]
        full = None  # an anchor whose rows all go to the other join

        def out(found, alone):
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
            a = np.concatenate([pairs[:, 0], alone]).view(np.int64)
            b = np.concatenate([pairs[:, 1], np.zeros(len(alone), np.uint64)]).view(np.int64)
            none = np.arange(len(a)) >= len(pairs)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=none)], schema=schema)

        for batch in batches:
            new = [
                batch.column("anchor").to_numpy(),
                batch.column("fingerprint").to_numpy().view(np.uint64),
                batch.column("home").to_numpy(zero_copy_only=False),
            ]
            anchor, value, home = (np.concatenate(x) for x in zip(kept, new))
            alone = np.empty(0, np.uint64)
            if full is not None:
                same = np.searchsorted(anchor, full, side="right")
                alone, anchor, value, home = value[:same], anchor[same:], value[same:], home[same:]
                if len(anchor):
                    full = None
            last = np.searchsorted(anchor, anchor[-1]) if len(anchor) else 0
            if len(anchor) - last > bucket:
                full = anchor[-1]
                alone = np.concatenate([alone, value[last:]])
                anchor, value, home = anchor[:last], value[:last], home[:last]
            kept = [anchor[last:], value[last:], home[last:]]
            found = [x for x in links(anchor[:last], value[:last], home[:last]) if len(x)]
            yield out(found, alone)
        found = [x for x in links(*kept) if len(x)] if len(kept[0]) else []
        yield out(found, np.empty(0, np.uint64))

    return run


def close_links(values: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """Links a, b that connect just the fingerprints connected by differences of at most limit bits."""
    if not 0 <= limit <= 2:
        raise ValueError("the join for full anchors is made for 2 bits or fewer")
    distinct = values.select("fingerprint").distinct()
    schema = T.StructType.fromDDL("anchor bigint, fingerprint bigint, home boolean")
    tasks = common.shuffle_tasks(values.sparkSession)
    # A fingerprint is a few bytes but becomes 61 rows: adaptive execution would leave all of them to a few tasks.
    sent = distinct.repartition(tasks, "fingerprint").mapInArrow(_replicate(limit), schema)
    sorted_ = sent.repartition(tasks, "anchor").sortWithinPartitions("anchor")
    pair = T.StructType.fromDDL("a bigint, b bigint")
    found = scratch.written(sorted_.mapInArrow(_compare(limit, bucket), pair).distinct(), "close-fingerprints")
    return found.filter("b is not null").unionByName(flipped_links(found.filter("b is null").select("a"), limit))


def flipped_links(values: DataFrame, limit: int) -> DataFrame:
    """The same links by meeting at values with one bit changed; the column is a."""
    bits = F.array(F.col("a"), *[F.col("a").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    met = values.distinct().select("a", F.explode(bits).alias("meeting"))
    groups = met.groupBy("meeting").agg(F.collect_set("a").alias("own")).filter("size(own) > 1")  # at most 65
    least = F.array_min("own")
    pairs = groups.select(F.explode("own").alias("a"), least.alias("b")).filter("a <> b").distinct()
    # At a meeting value two members differ by 2 bits at most; for a smaller limit compare all of them.
    if limit == 2:
        return pairs
    every = groups.select("own", F.explode("own").alias("a")).select("a", F.explode("own").alias("b"))
    return every.filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit).distinct()


def grouped(docs: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (signed long), component_id (smallest doc_id of the group)."""
    own = scratch.written(fingerprints(docs, shingle), "fingerprints")
    labels = components(close_links(own, limit, bucket))
    classes = own.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(labels, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = scratch.written(rooted.join(smallest, "root").select("fingerprint", "component_id"), "classes")
    return own.join(of_class, "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicated(docs: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group; rows without an id stay."""
    others = grouped(docs, limit, shingle).filter("doc_id <> component_id").select(F.col("doc_id").alias("__other"))
    return docs.join(others, F.col("doc_id") == F.col("__other"), "left_anti")


def op6_simhash_neighbours(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return grouped(docs).select("doc_id", text, "component_id")
