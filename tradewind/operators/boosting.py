"""Second-order gradient boosting of histogram trees for a 0/1 label, one ensemble per hash shard of the rows.

Rows are dealt to shards of about SHARD_ROWS by a hash of their key, as many shards as the table needs and at
most SHARDS; beyond SHARDS x SHARD_ROWS rows, those with the smallest hashes are fitted on (both bounds are
parameters). Each shard is one task: it cuts its features into bins once and grows its trees level by level from
sums of gradients and hessians per (node, feature, bin). The model is a table of tree nodes, and a
score is the logistic function of the mean margin of all shards' ensembles, so no row is met by more than one
ensemble while fitting, and a lost task grows the same trees again: rows are put in the order of their hash, columns are
drawn by (shard, round) and rows by (hash, round), whatever the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.sources.scratch import written

SHARD_ROWS = 100_000
SHARDS = 32
BINS = 256
#: Added to the hessian of every node, and the least hessian of a child.
RIDGE, LEAST_HESSIAN = 1.0, 1.0

NODES = "shard int, round int, node int, feature int, threshold double, value double, gain double, cover double"
LEAF = -1


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42


def cuts(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Rising thresholds between different values, at most bins - 1 of them; a value goes left if it is at most a threshold."""
    different = np.unique(values)
    if len(different) > bins:
        different = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="lower"))
    return (different[:-1] + different[1:]) / 2


def _uniform(keys: np.ndarray, number: int) -> np.ndarray:
    """A repeatable number in [0, 1) for every 64-bit key and round."""
    x = keys.view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).astype(float) / 2.0**64


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def best_splits(codes: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, columns: Sequence[int], sizes: Sequence[int]):
    """For each of the level's nodes: (gain, feature, bin) of the best split; a gain of 0 is none."""
    gain, feature, at = np.zeros(nodes), np.full(nodes, LEAF), np.zeros(nodes, np.int64)
    for c in columns:
        width = sizes[c] + 1
        if width < 2:
            continue
        place = node * width + codes[:, c]
        sums = [np.bincount(place, x, nodes * width).reshape(nodes, width).cumsum(axis=1) for x in (g, h)]
        (gl, g_all), (hl, h_all) = [(s[:, :-1], s[:, -1:]) for s in sums]
        gr, hr = g_all - gl, h_all - hl
        found = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g_all**2 / (h_all + RIDGE)
        found = np.where((hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), found, 0.0)
        top = found.argmax(axis=1)
        best = found[np.arange(nodes), top]
        better = best > gain * (1 + 1e-12)
        gain, feature, at = np.where(better, best, gain), np.where(better, c, feature), np.where(better, top, at)
    return gain, feature, at


def grown(x: np.ndarray, label: np.ndarray, weight: np.ndarray, keys: np.ndarray, shard: int, settings: Settings) -> pd.DataFrame:
    """NODES of the ensemble fitted on one shard's rows. Node i has the children 2i + 1 (at most the threshold) and 2i + 2."""
    n, width = x.shape
    thresholds = [cuts(x[:, c]) for c in range(width)]
    sizes = [len(t) for t in thresholds]
    codes = np.stack([np.searchsorted(t, x[:, c], side="left") for c, t in enumerate(thresholds)], axis=1)
    margin = np.zeros(n)
    rows = []
    for number in range(settings.rounds):
        p = _logistic(margin)
        drawn = weight * (_uniform(keys, number) < settings.row_share)
        g, h = drawn * (p - label), drawn * p * (1 - p)
        random = np.random.default_rng([settings.seed, shard, number])
        columns = np.sort(random.choice(width, max(1, round(settings.column_share * width)), replace=False))
        node = np.zeros(n, np.int64)  # place in the tree
        live = np.ones(n, bool)  # not yet in a leaf
        for level in range(settings.depth + 1):
            first, count = (1 << level) - 1, 1 << level
            own = node[live] - first
            g_sum, h_sum = np.bincount(own, g[live], count), np.bincount(own, h[live], count)
            there = np.bincount(own, minlength=count) > 0
            if level < settings.depth:
                gain, feature, at = best_splits(codes[live], own, g[live], h[live], count, columns, sizes)
            else:
                gain, feature, at = np.zeros(count), np.full(count, LEAF), np.zeros(count, np.int64)
            value = -settings.rate * g_sum / (h_sum + RIDGE)
            for i in np.flatnonzero(there):
                f = int(feature[i])
                cut = float(thresholds[f][at[i]]) if f != LEAF else 0.0
                rows.append((shard, number, first + int(i), f, cut, float(value[i]), float(gain[i]), float(h_sum[i])))
            split = feature[own] != LEAF
            index = np.flatnonzero(live)
            ended = index[~split]
            margin[ended] += value[node[ended] - first]
            live[ended] = False
            index, own = index[split], own[split]
            right = codes[index, feature[own]] > at[own]
            node[index] = 2 * node[index] + 1 + right
            if not len(index):
                break
    names = [c.split()[0] for c in NODES.split(", ")]
    return pd.DataFrame(rows, columns=names)


def fit(
    table: DataFrame, features: Sequence[str], label: str, weight: str, key: str, settings: Settings = Settings(),
    shard_rows: int = SHARD_ROWS, most_shards: int = SHARDS,
) -> DataFrame:
    """The model as a stored table of NODES. A row without features, label or weight must not be in table."""
    hashed = F.xxhash64(F.lit(settings.seed), F.col(key))
    n = table.count()
    shards = min(most_shards, max(1, math.ceil(n / shard_rows)))
    share = min(1.0, shards * shard_rows / max(n, 1))
    spread = 1 << 30
    rows = table.select(
        F.pmod(F.shiftright(hashed, 32), F.lit(shards)).cast("int").alias("shard"), hashed.alias("hash"),
        F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
    ).filter(F.pmod("hash", F.lit(spread)) < F.lit(share) * spread)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["hash", "label", "weight"], kind="stable")
        x = np.stack(frame["x"].to_numpy())
        return grown(
            x, frame["label"].to_numpy(), frame["weight"].to_numpy(), frame["hash"].to_numpy(), int(frame["shard"].iloc[0]), settings
        )

    return written(rows.groupBy("shard").applyInPandas(run, NODES), "boosted-trees")


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (tree, node), and how many ensembles they are of."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    ensembles: int

    @staticmethod
    def of(model: DataFrame) -> Forest:
        nodes = model.toPandas()  # at most SHARDS x rounds x 2^(depth + 1) rows
        shards = sorted(nodes["shard"].unique())
        rounds = int(nodes["round"].max()) + 1 if len(nodes) else 0
        tree = nodes["shard"].map({s: i for i, s in enumerate(shards)}).to_numpy(np.int64) * rounds + nodes["round"].to_numpy(np.int64)
        size = int(nodes["node"].max()) + 1 if len(nodes) else 1
        shape = (len(shards) * rounds, size)
        feature, threshold, value = np.full(shape, LEAF), np.zeros(shape), np.zeros(shape)
        at = (tree, nodes["node"].to_numpy(np.int64))
        feature[at], threshold[at], value[at] = nodes["feature"], nodes["threshold"], nodes["value"]
        return Forest(feature, threshold, value, max(1, len(shards)))

    def margins(self, x: np.ndarray) -> np.ndarray:
        total, each = np.zeros(len(x)), np.arange(len(x))
        depth = self.feature.shape[1].bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                asked = feature[node]
                inner = asked != LEAF
                right = x[each, asked] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += value[node]
        return total / self.ensembles


def scored(table: DataFrame, model: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """table with the probability of a 1 as column name; the model's nodes are sent to every task, bounded as said above."""
    shared = table.sparkSession.sparkContext.broadcast(Forest.of(model))
    schema = T.StructType([*table.schema.fields, T.StructField(name, T.DoubleType())])
    inputs = table.withColumn("__x", F.array(*[F.col(c).cast("double") for c in features]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features))
            p = pa.array(_logistic(shared.value.margins(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], p], names=[*batch.schema.names[:-1], name])

    return inputs.mapInArrow(run, schema)


def importances(model: DataFrame, features: Sequence[str]) -> list[float]:
    """Mean gain of the splits on each feature, as shares of their sum."""
    found = model.filter(F.col("feature") != LEAF).groupBy("feature").agg(F.avg("gain").alias("gain")).collect()
    gains = {r["feature"]: r["gain"] for r in found}  # a row per feature
    total = sum(gains.values()) or 1.0
    return [gains.get(i, 0.0) / total for i in range(len(features))]
