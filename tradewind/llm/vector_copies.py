"""Near-duplicate embeddings by sorted projection passes.

Vectors with equal values are one class from the start, and only classes are compared. A pass draws BITS random
hyperplanes; the signs of a vector's projections, one hash after the other, make its code, and the
classes are ordered by their codes as strings of bits. Near vectors share long beginnings of their codes, so
many of them stand close together: each is compared with the next WINDOW ones by cosine in double
precision. A pass hands on a forest of the links it has verified, the union of all passes is closed into
components.

The order is global: rows get places from a range sort, blocks of BLOCK places are compared in a task, and the
first WINDOW places of the next block are sent along. Equal codes are ordered by a hash of the class, so
they can be cut anywhere and no value is hot.

A pair at the threshold keeps a common beginning of b bits with probability (1 - angle / pi)^b, and it needs
about log2(classes / WINDOW) bits to stand within a window. passes() takes as many passes as leave MISS of such pairs
unseen by all of them; nearer pairs, and vectors with several near copies, are missed far more rarely.

The window bounds what a pass looks at, not what is linked: once the components are known, links are
counted inside each component between all of its classes, in cells of at most about CELL x CELL rows that multiply two
matrices and return a count per row. No pair of a component is left out or written down. The products of a component grow with the
square of the number of its different vectors (copies do not count).

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept.
Vectors of different lengths are never linked. Rows without an id link like others; component_id is
null only if no row of a component has an id, and kept compares null-safely. Repeated ids are rows of their own,
linked to each other if their vectors are. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm import common
from tradewind.llm.components import components
from tradewind.sources import scratch

COSINE = 0.95
BITS = 62
WINDOW = 1_024
BLOCK = 8_192
CELL = 8_192
#: Rows of one matrix product.
CHUNK = 512
#: Share of isolated pairs just at the threshold that all passes together may miss.
MISS = 0.001
SEED = 23


def passes(classes: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    bits = max(0.0, math.log2(max(classes, 1) / window))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if met > 1 - miss else math.ceil(math.log(miss) / math.log(1 - met))


def unit(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # no overflow in the squares
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def marked(vectors: DataFrame) -> DataFrame:
    """vec_id, h1, h2: two 64-bit hashes that stand for the values of a vector, null if it links with nothing."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = F.coalesce(sound & F.exists(x, lambda c: c != 0), F.lit(False))
    return common.renamed_clear(vectors, ("vec_id", "embedding")).select(
        "vec_id",
        F.when(good, x).alias("embedding"),
        F.when(good, F.xxhash64(x)).alias("h1"),
        F.when(good, F.xxhash64(F.lit(SEED), x)).alias("h2"),
    )


def classes_of(rows: DataFrame) -> DataFrame:
    """h1, h2, embedding, copies, first (smallest id), key (a number of its own), one row per different vector."""
    found = rows.filter(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(
        F.any_value("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first")
    )
    return scratch.written(found.withColumn("key", F.monotonically_increasing_id()), "vector-classes")


def coded(classes: DataFrame, number: int) -> DataFrame:
    """key, embedding, width, code of one pass."""
    struct = T.StructType(
        [classes.schema["key"], classes.schema["embedding"], T.StructField("width", T.IntegerType()), T.StructField("code", T.LongType())]
    )
    target = common.to_arrow(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                if width not in planes:
                    random = np.random.default_rng([SEED, number, int(width)])
                    planes[width] = random.standard_normal((int(width), BITS))
                own = batch.filter(pa.array(widths == width))
                signs = unit(own.column("embedding")) @ planes[width] > 0
                code = signs.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                columns = [own.column(f.name).cast(f.type) for f in target if f.name != "code"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code)], schema=target)

    return classes.select("key", "embedding", F.size("embedding").alias("width")).mapInArrow(run, struct)


def grouped_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal values of names, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(vectors: np.ndarray, width: np.ndarray, cosine: float, window: int) -> np.ndarray:
    """label: for each row a row it is linked to, directly or not, by pairs of equal width at most window apart."""
    n = len(vectors)
    label = np.arange(n)
    for at in range(0, n, CHUNK):
        own = vectors[at : at + CHUNK]
        ahead = slice(at, min(n, at + CHUNK + window))
        near = own @ vectors[ahead].T >= cosine
        near &= width[at : at + len(own), None] == width[None, ahead]
        i, j = np.indices(near.shape, sparse=True)
        near &= (j > i) & (j - i <= window)
        for row in np.flatnonzero(near.any(axis=1)):
            groups = np.unique(label[np.r_[at + row, at + np.flatnonzero(near[row])]])
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
    return label


def _padded(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a table with vectors of any widths, zeros after the shorter ones; and the widths."""
    width = table.column("width").to_numpy()
    out = np.zeros((len(width), width.max()))
    for w in np.unique(width):
        mine = width == w
        out[mine, :w] = unit(table.filter(pa.array(mine)).column("embedding"))
    return out, width


def window_links(classes: DataFrame, number: int, cosine: float, window: int, block: int) -> DataFrame:
    """a, b: a forest of the links that one pass finds."""
    spark = classes.sparkSession
    order = ["width", "code", F.xxhash64("key")]
    ordered = (
        coded(classes, number)
        .repartitionByRange(common.shuffle_tasks(spark), *order)
        .sortWithinPartitions(*order)
        .select("key", "embedding", "width", F.monotonically_increasing_id().alias("at"))
    )
    ordered = scratch.written(ordered, "projection-order")
    task = F.shiftright("at", 33)  # as monotonically_increasing_id numbers its rows
    so_far = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy(task.alias("task")).agg(F.count("*").alias("n")).select(
        "task", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("offset")
    )  # one row per task
    place = F.col("offset") + F.col("at") - F.shiftleft("task", 33)
    placed = ordered.withColumn("task", task).join(F.broadcast(offsets), "task").select(
        "key", "embedding", "width", place.alias("place")
    )
    own = F.expr(f"place div {block}")
    also = F.when((F.col("place") % block < window) & (own > 0), own - 1)
    sent = placed.withColumn("block", F.explode(F.array_compact(F.array(own, also))))
    rows = sent.repartition(common.shuffle_tasks(spark), "block").sortWithinPartitions("block", "place")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["block"]):
            vectors, width = _padded(table)
            label = forest(vectors, width, cosine, window)
            key = table.column("key").to_numpy()
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(key[moved]), pa.array(key[label[moved]])], schema=schema)

    return scratch.written(rows.mapInArrow(run, "a bigint, b bigint"), "projection-links")


def counted(members: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """key, linked: the vectors in other classes of the same component that each class links to directly.

    members: key, component, embedding, copies.
    """
    spark = members.sparkSession
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / cell).alias("parts"))
    dealt = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    cells = dealt.withColumn("other", other).select(
        "component", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part",
        "key", "copies", "embedding", F.size("embedding").alias("width"),
    )
    names = ["component", "one", "two"]
    rows = cells.repartition(common.shuffle_tasks(spark), *names).sortWithinPartitions(*names)
    schema = pa.schema([("key", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, names):
            vectors, _ = _padded(table)  # a component has one width
            key, copies, part = (table.column(c).to_numpy() for c in ("key", "copies", "part"))
            one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
            first, second = np.flatnonzero(part == one), np.flatnonzero(part == two)
            linked = np.zeros(len(key), np.int64)
            for at in range(0, len(first), CHUNK):
                own = first[at : at + CHUNK]
                near = vectors[own] @ vectors[second].T >= cosine
                near &= own[:, None] != second[None, :]
                linked[own] += near @ copies[second]
                if one != two:
                    linked[second] += copies[own] @ near
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(linked)], schema=schema)

    return rows.mapInArrow(run, "key bigint, linked bigint").groupBy("key").agg(F.sum("linked").alias("linked"))


def near_copies(
    vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, block: int = BLOCK, cell: int = CELL,
    miss: float = MISS, rounds: Callable[[int], int] | None = None,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    rows = marked(vectors)
    classes = classes_of(rows)
    total = classes.count()
    found = None
    for number in range(rounds(total) if rounds else passes(total, cosine, window, miss)):
        links = window_links(classes, number, cosine, window, block)
        found = links if found is None else found.unionByName(links)
    labels = components(found)
    members = classes.join(labels, F.col("key") == F.col("node")).select("key", "component", "embedding", "copies", "first")
    members = scratch.written(members, "vector-members")
    least = members.groupBy("component").agg(F.min("first").alias("smallest"))
    linked = counted(members.drop("first"), cosine, cell).join(members.select("key", "component"), "key").join(
        least, "component"
    )
    known = classes.select("key", "h1", "h2", "copies", "first").join(linked, "key", "left").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"),
        F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("smallest"),
    )
    known = scratch.written(known, "vector-links")
    alone = F.col("h1").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("smallest"))
    return rows.drop("embedding").join(known, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op13_sorted_projections(spark, sf_dir: str) -> DataFrame:
    return near_copies(common.table(spark, sf_dir, "embeddings"))
