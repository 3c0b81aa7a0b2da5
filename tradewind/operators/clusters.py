"""k-means over all rows for many models at once: each iteration is one pass for every model still moving.

A model is a number of clusters and a restart. A task folds its rows into sums per (model, centre), Spark
adds those up, and the driver moves the centres: models x clusters rows, whatever the table. Starts are
drawn over all rows as in k-means||, by weighted races keyed by a hash of the row, so neither partitions
nor repeated tasks change them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PASSES = 300
TOLERANCE = 1e-4  # movement of a centre; columns are expected to have unit variance
START_ROUNDS = 2
START_FACTOR = 2  # candidates a round, times the number of clusters
CHUNK = 4096  # rows whose distances are held at once
KEY = "__key"


@dataclass(frozen=True)
class Fit:
    """One model: centres, rows per centre, sum of squared distances, and whether the centres came to rest."""

    centers: np.ndarray
    sizes: np.ndarray
    cost: float
    rested: bool

    def nearest(self, columns: Sequence[str]) -> Column:
        """The number of the nearest centre, ties to the smaller."""
        gaps = [
            F.struct(
                sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, center)), F.lit(0.0)).alias("gap"),
                F.lit(i).alias("centre"),
            )
            for i, center in enumerate(self.centers)
        ]
        return F.array_min(F.array(*gaps))["centre"]


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1), one for each 64-bit key, independent between salts."""
    z = keys.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _closest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of each row."""
    label = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
    return label, ((x - centers[label]) ** 2).sum(1)


def _folded(
    points: DataFrame, columns: Sequence[str], start: Callable[[], dict], fold: Callable, rows: Callable, schema: str
) -> DataFrame:
    """One pass: each task folds its rows, in chunks, into a state and then gives the rows of the state."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
            keys = batch.column(KEY).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), CHUNK):
                fold(state, x[i:i + CHUNK], keys[i:i + CHUNK])
        found = rows(state)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), fields)], schema=fields)

    types = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = pa.schema([(name, types[kind]) for name, kind in (part.split() for part in schema.split(", "))])
    return points.select(*names, KEY).mapInArrow(run, schema)


def _sums(points: DataFrame, columns: Sequence[str], models: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per model an array of one row per centre: count, sum of each column, sum of squared norms, cost."""
    width = len(columns) + 3

    def fold(state: dict, x: np.ndarray, keys: np.ndarray) -> None:
        square = (x**2).sum(1)
        for m, centers in models.items():
            label, gap = _closest(x, centers)
            parts = [None, *x.T, square, gap]
            found = [np.bincount(label, weights=w, minlength=len(centers)) for w in parts]
            state[m] = state.get(m, 0) + np.column_stack(found)

    def rows(state: dict) -> list[tuple]:
        return [(m, i, *map(float, row)) for m, total in state.items() for i, row in enumerate(total) if row[0]]

    names = [f"s{i}" for i in range(width)]
    schema = "model int, centre int, " + ", ".join(f"{n} double" for n in names)
    added = _folded(points, columns, dict, fold, rows, schema).groupBy("model", "centre").agg(
        *[F.sum(n).alias(n) for n in names]
    )
    totals = {m: np.zeros((len(centers), width)) for m, centers in models.items()}
    for row in added.collect():  # a row per model and centre
        totals[row.model][row.centre] = row[2:]
    return totals


def _drawn(
    points: DataFrame, columns: Sequence[str], chosen: dict[int, np.ndarray], wanted: dict[int, int], seed: int, turn: int
) -> dict[int, np.ndarray]:
    """Per model `wanted` more rows, drawn without replacement in proportion to the squared distance from those chosen.

    The winners of a race of exponential waiting times are such a draw; without chosen rows all weigh the same.
    """

    def fold(state: dict, x: np.ndarray, keys: np.ndarray) -> None:
        for m, number in wanted.items():
            weight = _closest(x, chosen[m])[1] if m in chosen else np.ones(len(x))
            some = np.flatnonzero(weight > 0)
            wait = -np.log(_uniform(keys[some], (seed * 1009 + m) * 31 + turn)) / weight[some]
            first = np.argsort(wait, kind="stable")[:number]
            best = [(w, tuple(v)) for w, v in zip(wait[first].tolist(), x[some[first]].tolist())]
            state[m] = sorted(state.get(m, []) + best)[:number]

    def rows(state: dict) -> list[tuple]:
        return [(m, wait, list(v)) for m, best in state.items() for wait, v in best]

    raced = _folded(points, columns, dict, fold, rows, "model int, wait double, point array<double>")
    place = F.row_number().over(Window.partitionBy("model").orderBy("wait", "point"))
    limit = max(wanted.values())
    found: dict[int, list] = {}
    for row in raced.withColumn("place", place).filter(F.col("place") <= limit).orderBy("model", "place").collect():
        if row.place <= wanted[row.model]:
            found.setdefault(row.model, []).append(row.point)
    return {m: np.array(v) for m, v in found.items()}


def _spread(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted candidates by k-means++, then moved to rest among the candidates."""
    rng = np.random.default_rng(seed)
    centers = candidates[[rng.choice(len(candidates), p=weights / weights.sum())]]
    while len(centers) < k:
        pull = weights * _closest(candidates, centers)[1]
        if not pull.sum() > 0:
            break  # fewer different rows than clusters
        centers = np.vstack([centers, candidates[rng.choice(len(candidates), p=pull / pull.sum())]])
    for _ in range(30):
        label, _ = _closest(candidates, centers)
        mass = np.bincount(label, weights=weights, minlength=len(centers))
        moved = np.column_stack([np.bincount(label, weights=weights * c, minlength=len(centers)) for c in candidates.T])
        moved = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centers)
        if np.allclose(moved, centers, rtol=0, atol=1e-12):
            break
        centers = moved
    return centers


def _starts(points: DataFrame, columns: Sequence[str], jobs: Sequence[tuple[int, int]], seed: int) -> dict[int, np.ndarray]:
    chosen = _drawn(points, columns, {}, {m: 1 for m in range(len(jobs))}, seed, 0) if jobs else {}
    if not chosen:
        return {}
    for turn in range(1, START_ROUNDS + 1):
        wanted = {m: START_FACTOR * jobs[m][0] for m in chosen}
        for m, more in _drawn(points, columns, chosen, wanted, seed, turn).items():
            chosen[m] = np.vstack([chosen[m], more])
    chosen = {m: np.unique(c, axis=0) for m, c in chosen.items()}
    weights = _sums(points, columns, chosen)
    return {m: _spread(c, weights[m][:, 0], jobs[m][0], seed + jobs[m][1]) for m, c in chosen.items()}


def keyed(points: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The columns to cluster (NULL-free numbers) and the hash of the key that draws go by."""
    return points.select(*columns, F.xxhash64(*key).alias(KEY))


def best_kmeans(
    points: DataFrame, columns: Sequence[str], key: Sequence[str], ks: Sequence[int], restarts: int, seed: int,
    max_passes: int = MAX_PASSES,
) -> dict[int, Fit]:
    """For each k the cheapest of `restarts` models; none for an empty table.

    points: a stored table; key: columns that tell its rows apart. With fewer different rows than k a
    model has fewer centres. A centre that loses all rows stays where it is. Centres move beyond their
    means by a growing share of the last move, and back as soon as that costs more: fewer passes to rest.
    """
    rows = keyed(points, columns, key)
    jobs = [(k, r) for k in ks for r in range(restarts)]
    centers = _starts(rows, columns, jobs, seed)
    moving, steps, means, lowest = set(centers), dict.fromkeys(centers, 0), dict(centers), dict.fromkeys(centers, np.inf)
    for _ in range(max_passes):
        if not moving:
            break
        for m, total in _sums(rows, columns, {m: centers[m] for m in sorted(moving)}).items():
            cost, count = total[:, -1].sum(), total[:, :1]
            if steps[m] > 1 and cost > lowest[m]:  # the longer step went uphill: back to the plain one
                centers[m], steps[m] = means[m], 0
                continue
            moved = np.where(count > 0, total[:, 1:-2] / np.maximum(count, 1), centers[m])
            if np.sqrt(((moved - centers[m]) ** 2).sum(1)).max() <= TOLERANCE:
                moving.discard(m)
                centers[m] = moved
                continue
            steps[m] += 1
            reach = (steps[m] - 1) / (steps[m] + 2)
            centers[m], means[m], lowest[m] = moved + reach * (moved - means[m]), moved, cost
    centers |= {m: means[m] for m in moving}
    best: dict[int, Fit] = {}
    for m, total in (_sums(rows, columns, centers) if centers else {}).items():
        k, cost = jobs[m][0], float(total[:, -1].sum())
        if k not in best or cost < best[k].cost:
            best[k] = Fit(centers[m], total[:, 0], cost, m not in moving)
    return best


def silhouettes(points: DataFrame, columns: Sequence[str], key: Sequence[str], fits: dict[int, Fit]) -> dict[int, float]:
    """Mean silhouette over all rows by squared Euclidean distance, for all fits in two passes.

    The mean squared distance of a row to a cluster follows from the cluster's count, sum and sum of squared
    norms. A row alone in its cluster counts 0; NaN for a fit with one cluster.
    """
    rows = keyed(points, columns, key)
    centers = {k: fit.centers for k, fit in fits.items() if (fit.sizes > 0).sum() > 1}
    scores = {k: float("nan") for k in fits}
    if not centers:
        return scores
    totals = _sums(rows, columns, centers)

    def fold(state: dict, x: np.ndarray, keys: np.ndarray) -> None:
        square, each = (x**2).sum(1), np.arange(len(x))
        for k, total in totals.items():
            n, held = total[:, 0], total[:, 0] > 0
            label, _ = _closest(x, centers[k])
            size = np.maximum(n, 1)
            mean = square[:, None] + total[:, -2] / size - 2 * x @ (total[:, 1:-2] / size[:, None]).T
            mean = np.maximum(mean, 0)
            own = mean[each, label] * n[label] / np.maximum(n[label] - 1, 1)
            mean[:, ~held] = np.inf
            mean[each, label] = np.inf
            other = mean.min(1)
            score = np.where(n[label] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
            state[k] = state.get(k, np.zeros(2)) + [len(x), score.sum()]

    def found(state: dict) -> list[tuple]:
        return [(k, float(n), float(s)) for k, (n, s) in state.items()]

    added = _folded(rows, columns, dict, fold, found, "model int, n double, score double").groupBy("model").agg(
        (F.sum("score") / F.sum("n")).alias("mean")
    )
    return scores | {r.model: r["mean"] for r in added.collect()}
