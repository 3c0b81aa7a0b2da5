"""Removal of word sequences that also occur in an earlier document: seed and extend.

Every run of MIN_WORDS words holds a seed: the GRAM-word group with the smallest hash in it (winnowing).
Seeds are counted over the corpus, and documents are joined on those that occur twice. Each such
occurrence is then extended both ways, as far as runs of MIN_WORDS words that own the seed reach, and
compared with all occurrences of the seed at once: for each split of the missing words into words on the
left and on the right, occurrences with the same words (the same seed and the same 64-bit hash of the
run) form a class, and all but those of the smallest document are repeats. A run and its copy own the
same seed at the same place, so none is missed and none is compared twice. Runs that touch are merged,
which gives the maximal repeats.

Occurrences of a seed meet in one task only up to HOT of them. For seeds that are more frequent, the
smallest document of each run is found by an aggregate that combines before the shuffle, and joined
back by a join whose large keys Spark splits. Documents with equal texts are found by a digest first and
take no part: all runs of such a copy stand in the document it repeats.

Words are [^\\x20\\x09-\\x0D]+ unchanged. Null and empty texts have none. Documents without an id are
neither repeats nor sources. Rows that share an id count as one document. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm import common
from tradewind.sources import scratch

MIN_WORDS = 13
GRAM = 5
#: Occurrences of a seed that are compared in one task.
HOT = 4_096
#: Words on either side of a seed within a run.
SIDE = MIN_WORDS - GRAM
#: Bytes of text that are looked at together (or one text, if it is longer).
CHUNK = 1 << 20
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 256
PRIME = np.uint64(0xD6E8FEB86659FD93)


def spread(values: np.ndarray) -> np.ndarray:
    """Each value mixed over 64 bits."""
    out = (values + np.uint64(1)) * common.MIX
    out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(31)


BYTE = spread(np.arange(256, dtype=np.uint64))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to size - 1 of PRIME and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x)]) for x in (PRIME, inverse))


class Texts:
    """The words of some texts, end to end: text each stands in, and a hash of its bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_texts = len(offsets) - 1
        space = SPACE[data]
        new = np.r_[True, space[:-1]]
        new[offsets[:-1][offsets[:-1] < len(data)]] = True  # a text's first word starts with the text
        last = np.r_[space[1:], True]
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        starts, ends = np.flatnonzero(new & ~space), np.flatnonzero(last & ~space) + 1
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        self.counts = np.bincount(self.text, minlength=self.n_texts)
        up, down = powers(1 << max(10, len(data)).bit_length())
        sums = np.r_[np.uint64(0), np.cumsum(BYTE[data] * up[: len(data)])]
        length = ends - starts
        self.hash = spread((sums[ends] - sums[starts]) * down[starts] ^ length.astype(np.uint64) << np.uint64(48))
        for i in np.flatnonzero(length > LONG_WORD):
            self.hash[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())


def texts_of(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """A column in runs of rows of about CHUNK bytes: number of the first row, and the words of the run."""
    whole = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(whole):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        own = offsets[first : end + 1]
        yield first, Texts(data[own[0] : own[-1]], own - own[0])
        first = end


class Seeds:
    """The seeds of texts: text, place among all words, hash, splits (most and fewest words on the left)."""

    def __init__(self, words: Texts):
        n = len(words.hash) - MIN_WORDS + 1
        if n <= 0:
            self.text = self.at = self.most = self.fewest = np.empty(0, np.int64)
            self.hash, self.runs = np.empty(0, np.uint64), np.empty((0, SIDE + 1), np.uint64)
            return
        least = common.rolled(words.hash, GRAM)
        grams, step, size = least, np.zeros(len(least), np.int64), 1
        while size <= SIDE:  # the leftmost minimum of ever longer runs of groups
            move = min(size, SIDE + 1 - size)
            right = least[move:] < least[:-move]
            step = np.where(right, step[move:] + move, step[:-move])
            least = np.where(right, least[move:], least[:-move])
            size += move
        owner = step + np.arange(n)
        whole = words.text[:n] == words.text[MIN_WORDS - 1 :]  # runs that stay in a text
        new = np.r_[True, (owner[1:] != owner[:-1]) | ~whole[:-1]] & whole
        end = np.r_[(owner[1:] != owner[:-1]) | ~whole[1:], True] & whole
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        self.at = owner[first]
        self.text, self.hash = words.text[self.at], grams[self.at]
        self.most, self.fewest = self.at - first, self.at - last
        # A hash of the whole run for every number of words on the left of the seed.
        left = np.arange(SIDE + 1)
        owned = (self.fewest[:, None] <= left) & (left <= self.most[:, None])
        at = np.clip(self.at[:, None] - left, 0, n - 1)
        self.runs = common.rolled(words.hash, MIN_WORDS)[at] * owned

    def keys(self) -> np.ndarray:
        """One 64-bit key for seed, splits and runs."""
        splits = self.most.astype(np.uint64) << np.uint64(8) | self.fewest.astype(np.uint64)
        return mixed(np.c_[self.hash, splits, self.runs])


def mixed(columns: np.ndarray, seed: int = 1) -> np.ndarray:
    out = np.full(len(columns), seed, np.uint64)
    for column in columns.T:
        out = (out ^ column) * PRIME
        out ^= out >> np.uint64(31)
    return out


def paired(text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A key for a text of a run of rows together with a value."""
    return spread(values) ^ spread(text.astype(np.uint64) << np.uint64(32))


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row that each element of a list column stands in, and the elements."""
    sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _map(df: DataFrame, schema: str, columns) -> DataFrame:
    """Over runs of rows: columns gives arrays from ids, words, seeds, keys and places of distinct seeds.

    Only seeds in the row's list chosen are looked at, if df has that column.
    """
    struct = T.StructType.fromDDL(schema)
    target = common.to_arrow(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if "chosen" in batch.schema.names:
                row, chosen = flat(batch.column("chosen"))
                chosen = chosen.to_numpy().view(np.uint64)
            else:
                chosen = None
            for first, words in texts_of(batch.column("text")):
                seeds = Seeds(words)
                keys = seeds.keys()
                _, at = np.unique(paired(seeds.text, keys), return_index=True)
                if chosen is not None:
                    own = (row >= first) & (row < first + words.n_texts)
                    wanted = paired(row[own] - first, chosen[own])
                    at = at[np.isin(paired(seeds.text[at], seeds.hash[at]), wanted)]
                if len(at):
                    found = columns(ids[first + seeds.text[at]], seeds, keys, at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(x), f.type) for x, f in zip(found, target)], schema=target
                    )

    return df.mapInArrow(run, struct)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64) if values.dtype == np.uint64 else values


def _seed_counts(ids, seeds, keys, at):
    order = np.lexsort((seeds.hash[at], seeds.text[at]))
    hashes, texts = seeds.hash[at][order], seeds.text[at][order]
    start = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])])
    return hashes[start], ids[order][start], np.diff(np.r_[start, len(order)])


def _occurrences(ids, seeds, keys, at):
    return seeds.hash[at], ids, seeds.most[at] << 8 | seeds.fewest[at], keys[at], *seeds.runs[at].T


def _runs(ids, seeds, keys, at):
    out = []
    for left in range(SIDE + 1):
        some = (seeds.fewest[at] <= left) & (left <= seeds.most[at])
        own = at[some]
        out.append((seeds.hash[own], seeds.runs[own, left], ids[some], keys[own], np.full(len(own), 1 << left)))
    return [np.concatenate(x) for x in zip(*out)]


def _compared():
    """Over occurrences sorted by seed: (id, key, repeats), the bits of the splits found in a smaller document."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("repeats", pa.int64())])

    def repeats(table: pa.Table) -> pa.RecordBatch:
        seed, doc, splits = (table.column(c).to_numpy() for c in ("seed", "id", "splits"))
        found = np.zeros(len(seed), np.int64)
        for left in range(SIDE + 1):
            own = np.flatnonzero((splits & 255 <= left) & (left <= splits >> 8))
            if len(own) < 2:
                continue
            run, of = table.column(f"run{left}").to_numpy()[own], seed[own]
            order = np.lexsort((doc[own], run, of))
            start = np.r_[True, (run[order][1:] != run[order][:-1]) | (of[order][1:] != of[order][:-1])]
            first = doc[own][order][np.flatnonzero(start)[np.cumsum(start) - 1]]
            found[own[order[doc[own][order] > first]]] |= 1 << left
        some = found > 0
        keys = table.column("key").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(keys[some]), pa.array(found[some])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seed = batch.column("seed").to_numpy()
            last = int(np.searchsorted(seed, seed[-1]))
            if last:  # the last seed may go on in the next batch
                yield repeats(pa.Table.from_batches([*kept, batch.slice(0, last)]))
                kept = [batch.slice(last)]
            elif kept and kept[-1].column("seed")[0].as_py() != seed[-1]:
                yield repeats(pa.Table.from_batches(kept))
                kept = [batch]
            else:
                kept.append(batch)
        if kept:
            yield repeats(pa.Table.from_batches(kept))

    return run


def repeats(every: DataFrame, texts: DataFrame, hot: int = HOT) -> DataFrame:
    """id and found: array of (key, repeats) of the documents that hold repeats; both: id (bigint), text.

    Seeds are counted over every document as it is read; texts, without copies, are compared.
    """
    n_tasks = common.shuffle_tasks(texts.sparkSession)
    seeds = _map(every, "seed bigint, id bigint, n bigint", _seed_counts)
    frequent = seeds.groupBy("seed").agg(F.sum("n").alias("total")).filter("total > 1")
    shared = seeds.select("seed", "id").join(frequent, "seed")
    by_doc = scratch.written(
        shared.groupBy("id").agg(
            F.collect_list(F.when(F.col("total") <= hot, F.col("seed"))).alias("some"),
            F.collect_list(F.when(F.col("total") > hot, F.col("seed"))).alias("many"),
        ),
        "shared-seeds",
    )

    def chosen(kind: str) -> DataFrame:
        own = by_doc.filter(F.size(kind) > 0).select(F.col("id").alias("by_id"), F.col(kind).alias("chosen"))
        return texts.join(own, F.col("id") == F.col("by_id")).drop("by_id")

    held = ", ".join(f"run{left} bigint" for left in range(SIDE + 1))
    met = _map(chosen("some"), f"seed bigint, id bigint, splits bigint, key bigint, {held}", _occurrences)
    sorted_ = met.repartition(n_tasks, "seed").sortWithinPartitions("seed")
    found = sorted_.mapInArrow(_compared(), T.StructType.fromDDL("id bigint, key bigint, repeats bigint"))

    runs = _map(chosen("many"), "seed bigint, run bigint, id bigint, key bigint, repeats bigint", _runs)
    first = runs.groupBy("seed", "run").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    later = runs.join(first, ["seed", "run"]).filter("id > first").select("id", "key", "repeats")
    return found.unionByName(later).groupBy("id").agg(F.collect_list(F.struct("key", "repeats")).alias("found"))


def removed_words(words: Texts, copy: np.ndarray, row: np.ndarray, key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which words of texts are removed: all of a copy's, and the runs that (row, key, bits) name."""
    gone = copy[words.text] & (words.counts[words.text] >= MIN_WORDS)
    if len(row):
        seeds = Seeds(words)
        names = paired(row, key)
        order = np.argsort(names)
        start = np.flatnonzero(np.r_[True, names[order][1:] != names[order][:-1]])
        names, bits = names[order][start], np.bitwise_or.reduceat(bits[order], start)
        own = paired(seeds.text, seeds.keys())
        place = np.minimum(np.searchsorted(names, own), len(names) - 1)
        own_bits = np.where(names[place] == own, bits[place], 0)
        starts = np.concatenate([seeds.at[own_bits >> left & 1 > 0] - left for left in range(SIDE + 1)])
        n = len(gone) + 1
        edges = np.bincount(starts, minlength=n) - np.bincount(starts + MIN_WORDS, minlength=n)
        gone |= np.cumsum(edges[:-1]) > 0
    return gone


def kept_rows(text: pa.Array, copies: pa.Array, found: pa.Array) -> Iterator[tuple[int, list[dict], str]]:
    """(n_words, spans removed, words kept) of each row."""
    copy = copies.is_valid().to_numpy(zero_copy_only=False)
    row, elements = flat(found)
    key = elements.field("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    bits = elements.field("repeats").to_numpy(zero_copy_only=False).astype(np.int64)
    for first, words in texts_of(text):
        own = (row >= first) & (row < first + words.n_texts)
        end = first + words.n_texts
        gone = removed_words(words, copy[first:end], row[own] - first, key[own], bits[own])
        at = np.r_[0, np.cumsum(words.counts)]
        some = np.r_[0, np.cumsum(gone)]
        for i in range(words.n_texts):
            a, b = at[i], at[i + 1]
            raw = common.words(text[first + i].as_py())
            spans = []
            if some[b] > some[a]:
                mask = gone[a:b]
                sides = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).tolist()
                spans = [{"start": x, "end": y} for x, y in zip(sides[::2], sides[1::2])]
                raw = list(compress(raw, (~mask).tolist()))
            yield int(b - a), spans, b" ".join(raw).decode()


ADDED = "n_words bigint, removed array<struct<start: int, end: int>>, kept string"


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs with n_words, removed (maximal repeats, as spans of words) and kept (the words left, one space between).

    Columns of docs by these names are replaced. doc_id must be an integer.
    """
    names = [c for c in docs.columns if c not in ("n_words", "removed", "kept")]
    # Columns by place, so that none can clash with a working name; every map reads all of them, so
    # that the one exchange of the texts serves each.
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at_id, at_text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    some = own.filter(F.col(at_id).isNotNull())
    spread = some.repartition(common.shuffle_tasks(docs.sparkSession), at_id)

    digests = some.select(F.col(at_id).cast("bigint").alias("id"), F.md5(at_text).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    later = digests.join(least, "digest").filter("id > first")
    copies = later.select(F.col("id").alias("copy_id"), F.col("digest").alias("copy_digest")).distinct()
    # By id and digest: rows that repeat an id may have different texts. An equality would become a key of the
    # join, for which all texts would be exchanged once more.
    own_digest = F.md5(at_text)
    equal = (own_digest <= F.col("copy_digest")) & (own_digest >= F.col("copy_digest"))
    texts = spread.join(copies, (F.col(at_id) == F.col("copy_id")) & equal, "left").drop("copy_digest")
    alone = texts.filter("copy_id is null").withColumns({"id": F.col(at_id).cast("bigint"), "text": F.col(at_text)})
    every = some.select(F.col(at_id).cast("bigint").alias("id"), F.col(at_text).alias("text"))
    found = repeats(every, alone, hot).withColumnRenamed("id", "found_id")

    joined = texts.join(found, F.col(at_id) == F.col("found_id"), "left").unionByName(
        own.filter(F.col(at_id).isNull()), allowMissingColumns=True
    )
    schema = T.StructType([*own.schema.fields, *T.StructType.fromDDL(ADDED).fields])
    target, given = common.to_arrow(schema), set(own.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = list(kept_rows(*[batch.column(c) for c in (at_text, "copy_id", "found")]))
            made = [pa.array(x, target.field(c).type) for x, c in zip(zip(*results), ("n_words", "removed", "kept"))]
            same = [batch.column(f.name).cast(f.type) for f in target if f.name in given]
            if results:
                yield pa.RecordBatch.from_arrays([*same, *made], schema=target)

    return joined.mapInArrow(run, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(names)})


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs with the repeats taken out of text, the words left joined by one space; other texts as they are.

    A text that loses all of its words becomes empty; n_chars, where there is one, follows the text.
    """
    cut = F.size("removed") > 0
    changed = without_repeats(docs, hot).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withColumn(
            "n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return without_repeats(docs).select(
        "doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )
