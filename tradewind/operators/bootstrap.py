"""Percentile bootstrap of a difference of means, many experiments at once.

Every row takes part in a resample a Poisson(1) number of times, so n equal values together take part
Poisson(n) times: the draw is made once per (experiment, value), not per row, for blocks of values and
all replicates at once. Each draw is seeded by what it is for, so neither a task that runs again nor the
way rows are dealt changes it. A task keeps one set of sums and emits it when an experiment ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARMS = ("control", "variant")


BLOCK = 1 << 20  # draws made at once
SMALL = 64  # counts up to here are drawn by inversion from a table


@cache
def _poisson_table(n: int) -> np.ndarray:
    """Cumulative chances of a Poisson(n) number, until they reach 1 in double precision."""
    chance, total, out = math.exp(-n), 0.0, []
    k = 0
    while k <= n or chance > 1e-18:
        total += chance
        out.append(total)
        k += 1
        chance *= n / k
    return np.array(out)


def _uniform(seeds: np.ndarray, replicates: int, arm: int) -> np.ndarray:
    """One number in [0, 1) per seed and replicate, by mixing their counters."""
    at = np.arange(replicates, dtype=np.uint64) * np.uint64(2) + np.uint64(arm + 1)
    x = seeds[:, None] + at[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53


def _draws(counts: np.ndarray, seeds: np.ndarray, replicates: int, arm: int) -> np.ndarray:
    """How often the values take part: Poisson(count) by value and replicate, each drawn from its own seed."""
    out = np.zeros((len(counts), replicates))
    for n in np.unique(counts[counts > 0]).tolist():
        rows = np.flatnonzero(counts == n)
        if n <= SMALL:
            out[rows] = np.searchsorted(_poisson_table(n), _uniform(seeds[rows], replicates, arm), side="right")
        else:  # one generator for more than SMALL rows
            for row in rows:
                key = [int(seeds[row]), arm]
                out[row] = np.random.Generator(np.random.Philox(key=key)).poisson(n, replicates)
    return out


def _resampler(group: Sequence[str], replicates: int):
    """Over cells sorted by group: one row of sums per group and task."""

    def sums(cells: pd.DataFrame) -> np.ndarray:
        total = np.zeros((4, replicates))
        step = max(1, BLOCK // replicates)
        for at in range(0, len(cells), step):
            part = cells.iloc[at : at + step]
            value, seeds = part["__value"].to_numpy(), part["__seed"].to_numpy(np.int64).view(np.uint64)
            for arm, name in enumerate(("n_control", "n_variant")):
                times = _draws(part[name].to_numpy(), seeds, replicates, arm)
                total[2 * arm] += times.sum(axis=0)
                total[2 * arm + 1] += value @ times
        return total

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = None, None
        for batch in batches:
            if not len(batch):
                continue
            parts = [((), batch)] if not group else batch.groupby(list(group), dropna=False, sort=False)
            for key, cells in parts:
                key = tuple(None if pd.isna(k) else k for k in key)
                if key == held:
                    total += sums(cells)
                    continue
                if total is not None:
                    yield pd.DataFrame([[*held, *total]], columns=[*group, "w_c", "s_c", "w_v", "s_v"])
                held, total = key, sums(cells)
        if total is not None:
            yield pd.DataFrame([[*held, *total]], columns=[*group, "w_c", "s_c", "w_v", "s_v"])

    return resample


def bootstrap_means(counts: DataFrame, value: str, group: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """group, replicate, difference: mean(variant) - mean(control) of each resample.

    counts: one row per (group, value) with n_control and n_variant.
    """
    cells = counts.select(
        *group,
        F.col(value).cast("double").alias("__value"),
        "n_control",
        "n_variant",
        F.xxhash64(F.lit(seed), *group, value).alias("__seed"),
    )
    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("w_c", "s_c", "w_v", "s_v")]
    schema = T.StructType([counts.schema[g] for g in group] + arrays)
    # A small table, a lot of work per row: spread it by key instead of by bytes. By the seed, because a
    # repartition by the columns it is already grouped by would be dropped and the partitions merged.
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cells.repartition(tasks, "__seed").sortWithinPartitions(*group, "__seed")
    partial = spread.mapInPandas(_resampler(group, replicates), schema)
    return (
        partial.select(*group, F.posexplode(F.arrays_zip("w_c", "s_c", "w_v", "s_v")).alias("replicate", "z"))
        .groupBy(*group, "replicate")
        .agg(*[F.sum(f"z.{c}").alias(c) for c in ("w_c", "s_c", "w_v", "s_v")])
        .select(
            *group, "replicate",
            (F.try_divide("s_v", "w_v") - F.try_divide("s_c", "w_c")).alias("difference"),
        )
    )


def bootstrap_interval(
    counts: DataFrame, value: str, group: Sequence[str], alpha: float, replicates: int = 2000, seed: int = 42
) -> DataFrame:
    """group, ci_low, ci_high. The percentile sees one number per replicate, so its input is bounded."""
    ends = F.percentile("difference", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return (
        bootstrap_means(counts, value, group, replicates, seed)
        .groupBy(*group)
        .agg(ends.alias("ends"))
        .select(*group, F.col("ends")[0].alias("ci_low"), F.col("ends")[1].alias("ci_high"))
    )
