"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers x = floor(64 * c) + 1000000. The model is fitted on every distinct x vector
once: n of them, centred by their exact sums S. From a random unit vector the iteration builds orthonormal
v_1, v_2, ... in the space of dimensions and u_1, u_2, ... in the space of rows with

    X v_k = beta_(k-1) u_(k-1) + alpha_k u_k,        X' u_k = alpha_k v_k + beta_k v_(k+1).

Each step reads the centred rows once. A batch multiplies them with the current direction, w = X q, and adds
up U'w, w'w and X'w, so only sums of a few numbers per dimension leave a task. The u vectors, one entry
per row, are never stored or moved: u_k = X p_k for a short p_k, so a task finds its own entries again.
Every new u is made orthogonal to all earlier ones by U'w, every new v to all earlier ones twice. The
singular values of the small bidiagonal matrix and its right vectors, turned by V, are the deviations
(times the root of n) and the components.

By default the iteration runs through all dimensions, which finds repeated and close eigenvalues too; where
it breaks down (a repeated eigenvalue, a direction without variance) it goes on with a new random
direction. Fewer steps are a parameter: the leading components then have converged only as far as
the spectrum allows.

Nulls: a null vector or one with a null or non-finite entry is left out; a null id is kept. So are repeated rows,
each with the same result. Vectors of another length than the most frequent one (of several, the longest) cannot
share its components and are left out, as are entries beyond 2^55, which are no long once scaled. Components
without variance cannot be scaled to one and are not returned; an empty table, a single distinct vector and vectors of
length 0 give an empty result. Extra columns are ignored. A deviation beyond 2^63 is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm import common
from tradewind.sources import scratch

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
SEED = 7
#: Against the largest coefficient so far: below this a step has run out of directions.
BREAKDOWN = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S; components (a column each) and their eigenvalues, falling."""

    n: int
    sums: np.ndarray
    trace: float
    components: np.ndarray
    eigenvalues: np.ndarray
    identity_error: float = 0.0


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**55)))
    narrow = common.renamed_clear(vectors, ("vec_id", "embedding")).filter(F.col("embedding").isNotNull() & good)
    longs = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT).cast("bigint"))
    return narrow.select("vec_id", longs.alias("x"))


def exact_gaps(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: whole numbers of any size."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if largest * n < 1 << 61:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums.astype(object)


def summed(rows: DataFrame, totals: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of the numbers that totals gives for a task's batches.

    One more task adds up a row per task of the first stage.
    """
    schema = pa.schema([("part", pa.list_(pa.float64()))])

    def packed(numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([numbers.tolist()], schema.field(0).type)], schema=schema)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(totals(matrix(b.column("centred")) for b in batches if b.num_rows))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(sum(matrix(b.column("part")).sum(axis=0) for b in batches if b.num_rows))

    parts = rows.mapInArrow(inside, "part array<double>").repartition(1)
    return np.array(parts.mapInArrow(across, "part array<double>").collect()[0][0])  # one row


def _against(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v made orthogonal to the orthonormal basis, twice over."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            v = v - b.T @ (b @ v)
    return v


def bidiagonalised(rows: DataFrame, size: int, steps: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """V (a column per step) and the upper bidiagonal B with X V = U B; rows: column centred, array of double."""
    random = np.random.default_rng(seed)
    v_all: list[np.ndarray] = []
    p_all, z_all = np.zeros((steps, size)), np.zeros((steps, size))  # u_k = X p_k and X' u_k
    alpha, beta = np.zeros(steps), np.zeros(steps)

    def fresh() -> np.ndarray:
        v = _against(random.standard_normal(size), v_all)
        return v / np.linalg.norm(v)

    v = fresh()
    for k in range(steps):
        v_all.append(v)
        direction = v - beta[k - 1] * p_all[k - 1] if k else v
        earlier = p_all[:k]

        def totals(batches, direction=direction, earlier=earlier, k=k) -> np.ndarray:
            out = np.zeros(2 * size + 1)
            for x in batches:
                w = x @ direction
                out[:size] += w @ x
                out[size] += w @ w
                out[size + 1 : size + 1 + k] += w @ (x @ earlier.T)
            return out

        total = summed(rows, totals)
        overlaps = total[size + 1 : size + 1 + k]
        length = np.sqrt(max(0.0, total[size] - overlaps @ overlaps))
        largest = max(alpha.max(), beta.max(), length)
        if length > BREAKDOWN * largest:
            alpha[k] = length
            p_all[k] = (direction - overlaps @ earlier) / length
            z_all[k] = (total[:size] - overlaps @ z_all[:k]) / length
        if k + 1 == steps:
            break
        rest = _against(z_all[k] - alpha[k] * v, v_all)
        length = np.linalg.norm(rest)
        if length > BREAKDOWN * max(largest, np.finfo(float).tiny):
            beta[k], v = length, rest / length
        else:
            v = fresh()
    return np.array(v_all).T, np.diag(alpha) + np.diag(beta[:-1], 1)


def fitted(own: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """The model over the distinct vectors of own (column x, one length); None if no component has variance."""
    size = own.select(F.size("x")).first()
    size = size[0] if size else 0
    if size <= 0:
        return None
    distinct = scratch.written(own.select("x").distinct(), "whitening-fit")
    # Sums as decimals: exact for any number of rows.
    total = distinct.agg(F.count("*"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")) for i in range(size)]).first()
    n, sums = total[0], np.array([int(s) for s in total[1:]], object)
    if n < 2:
        return None

    schema = pa.schema([("centred", pa.list_(pa.float64()))])

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = exact_gaps(matrix(batch.column("x")), n, sums).astype(float) / n
                offsets = pa.array(np.arange(0, gaps.size + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(gaps.ravel()))], schema=schema)

    rows = scratch.written(distinct.mapInArrow(centre, "centred array<double>"), "whitening-rows")
    v, b = bidiagonalised(rows, size, min(steps or size, size))
    _, values, right = np.linalg.svd(b)
    found = int((values > values[0] * size * 1e-10).sum()) if values[0] > 0 else 0
    found = min(components, found)
    if not found:
        return None
    turned, eigenvalues = (v @ right.T)[:, :found], values[:found] ** 2 / n
    scale = np.sqrt(eigenvalues)

    def moments(batches) -> np.ndarray:
        out = np.zeros(found * found + 1)
        for x in batches:
            w = x @ turned / scale
            out[:-1] += (w.T @ w).ravel()
            out[-1] += (x * x).sum()
        return out

    total = summed(rows, moments)
    error = np.abs(total[:-1].reshape(found, found) / n - np.eye(found)).max()
    return Whitening(n, sums, total[-1] / n, turned, eigenvalues, float(error))


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def applied(own: DataFrame, model: Whitening) -> DataFrame:
    """A row per row of own and component."""
    kind = dict(own.dtypes)["vec_id"]
    size, found = len(model.sums), len(model.eigenvalues)
    target = common.to_arrow(own.sparkSession.createDataFrame([], f"vec_id {kind}, {SCHEMA}").schema)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            gaps = exact_gaps(matrix(batch.column("x")), model.n, model.sums)
            largest = int(np.abs(gaps).max())
            exact = gaps if largest * largest * size < 1 << 62 else gaps.astype(object)
            deviation = (exact * exact).sum(axis=1).tolist()
            whitened = gaps.astype(float) / model.n @ model.components / np.sqrt(model.eigenvalues)
            each = np.repeat(np.arange(rows), found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)).cast(target.field(0).type),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * found, model.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * found, model.identity_error)),
                ],
                schema=target,
            )

    return own.mapInArrow(run, f"vec_id {kind}, {SCHEMA}")


def whitened(vectors: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    vectors: vec_id, embedding (array of numbers).
    """
    own = scratch.written(scaled(vectors), "whitening-input")
    lengths = own.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("size")).first()  # a row per length
    if usual is not None:
        own = own.filter(F.size("x") == usual["size"])
    model = fitted(own, components, steps)
    if model is None:
        kind = dict(own.dtypes)["vec_id"]
        return own.sparkSession.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    return applied(own, model)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(common.table(spark, sf_dir, "embeddings"))
