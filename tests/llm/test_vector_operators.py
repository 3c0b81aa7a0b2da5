"""Whitening and embedding near-dedup against NumPy over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import vector_copies, whitening
from tradewind.llm.queries import queries

SCHEMA = "vec_id bigint, embedding array<double>"


def embeddings(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)
    return df.withColumns({n: F.lit("clash") for n in ("x", "key", "h1", "n", "component", "part", "label", "node")})


# --- whitening ----------------------------------------------------------------------------------------------


def check_whitening(found, rows, limit=16):
    """rows: (id, vector) that take part."""
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(limit, int((values > values[0] * 1e-12).sum()))
    by_row = {}
    for r in found.collect():
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    ids = [i for i, _ in rows]
    assert set(by_row) == set(ids)
    whitened = np.zeros((len(rows), count))
    for at, (i, _) in enumerate(rows):
        own = by_row[i]
        assert sorted(own) == list(range(1, count + 1))
        for k, copies in own.items():
            assert len(copies) == ids.count(i)
            deviations = {int((((x[j] * n) - sums) ** 2).sum()) for j in range(len(rows)) if ids[j] == i}
            for r in copies:
                assert r["n"] == n and r["deviation"] in deviations
                assert r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-6)
                assert 0 <= r["identity_error"] < 1e-6
            whitened[at, k - 1] = copies[0]["whitened"]
    expected = (x * n - sums) / n @ vectors[:, :count] / np.sqrt(values[:count])
    single = [at for at, i in enumerate(ids) if ids.count(i) == 1]
    return whitened[single], expected[single]


def test_whitening_is_the_eigen_decomposition(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    whitened, expected = check_whitening(queries()["op11_embedding_whitening"](spark, small), rows)
    signs = np.sign((whitened * expected).sum(axis=0))
    assert np.allclose(whitened * signs, expected, atol=1e-8)


def test_whitening_of_few_directions_repeats_and_unsound_rows(spark):
    random = np.random.default_rng(5)
    basis = random.standard_normal((3, 6))
    rows = [(i, random.standard_normal(3) @ basis * 3) for i in range(60)]
    # Whole multiples of 1/64, so that a constant and a copied dimension stay what they are.
    rows = [(i, np.r_[np.round(v * 64) / 64, 0.25, np.round(v[0] * 64) / 64]) for i, v in rows]
    rows += [(3, rows[3][1]), (100, rows[7][1]), (101, rows[7][1] + 0.001)]
    unsound = [(200, None), (201, [None] * 8), (202, [math.nan] * 8), (203, [math.inf] + [0.0] * 7), (204, [1.0]), (205, [])]
    whitened, expected = check_whitening(whitening.whitened(embeddings(spark, rows + unsound)), rows)
    signs = np.sign((whitened * expected).sum(axis=0))
    assert np.allclose(whitened * signs, expected, atol=1e-6)


def test_whitening_finds_repeated_eigenvalues(spark):
    # The corners of a cross: every direction has the same variance, so one start vector breaks down at once.
    rows = [(2 * i + s, np.eye(4)[i] * (1 if s else -1) * 2) for i in range(4) for s in (0, 1)]
    found = whitening.whitened(embeddings(spark, rows))
    whitened, _ = check_whitening(found, rows)
    assert np.allclose(whitened.T @ whitened / len(rows), np.eye(4), atol=1e-9)


def test_whitening_of_nothing_and_of_one_vector(spark):
    assert whitening.whitened(embeddings(spark, [])).count() == 0
    assert whitening.whitened(embeddings(spark, [(1, None), (2, [math.nan])])).count() == 0
    assert whitening.whitened(embeddings(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0
    assert whitening.whitened(embeddings(spark, [(1, []), (2, [])])).count() == 0


def test_deviations_are_exact_beyond_doubles(spark):
    rows = [(i, [1e6 * (i % 3), float(i), 0.0]) for i in range(9)]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whitened(embeddings(spark, rows)).collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert found == {i: sum((9 * c - s) ** 2 for c, s in zip(x[i], sums)) for i in range(9)}


# --- near-dedup ---------------------------------------------------------------------------------------------


def sound(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def near_by_hand(rows, cosine=0.95):
    n = len(rows)
    links = [0] * n
    group = list(range(n))
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if sound(v) else None for _, v in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                if group[i] != group[j]:
                    group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    return sorted(((i, links[k], least[group[k]], i == least[group[k]]) for k, (i, _) in enumerate(rows)), key=repr)


def found_links(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def clustered(random, sizes, singles, width=24, noise=0.03):
    rows = [random.standard_normal(width) for _ in range(singles)]
    for size in sizes:
        centre = random.standard_normal(width)
        centre /= np.linalg.norm(centre)
        rows += [centre + noise * random.standard_normal(width) for _ in range(size)]
    return [(int(i), v) for i, v in zip(random.permutation(len(rows)), rows)]


def test_near_dedup_is_brute_force(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert found_links(queries()["op13_sorted_projections"](spark, small)) == near_by_hand(rows)


def test_near_dedup_with_windows_and_cells_smaller_than_groups(spark):
    random = np.random.default_rng(9)
    rows = clustered(random, [150, 40] + [3] * 20, 400)
    df = embeddings(spark, rows)
    assert found_links(vector_copies.near_copies(df, window=16, block=64, cell=50)) == near_by_hand(rows)


def test_near_dedup_of_unsound_vectors_and_copies(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (5, base), (3, base), (3, base), (None, base), (8, [2 * x for x in base]), (9, [1.0, 2.0, 3.0, 4.1]), (10, [-x for x in base]),
        (11, None), (12, []), (13, [0.0] * 4), (14, [math.nan, 1.0, 1.0, 1.0]), (15, [None, 1.0, 1.0, 1.0]), (16, [math.inf, 1.0, 1.0, 1.0]),
        (17, [1.0, 2.0, 3.0]), (18, [1.0, 2.0, 3.1]), (None, None), (19, [1e200, 2e200, 3e200, 4e200]),
    ]
    expected = [(i, n, c, k) for i, n, c, k in near_by_hand([r for r in rows if r[0] != 19])]
    same = vector_copies.near_copies(embeddings(spark, [r for r in rows if r[0] != 19]))
    assert found_links(same) == expected
    large = {r["vec_id"]: r for r in vector_copies.near_copies(embeddings(spark, rows)).collect()}
    assert large[19]["component_id"] == 3 and not large[19]["kept"]
    assert vector_copies.near_copies(embeddings(spark, [])).count() == 0
    assert vector_copies.near_copies(embeddings(spark, [(1, None)])).count() == 1


def test_passes_grow_with_the_table():
    assert vector_copies.passes(0) == vector_copies.passes(vector_copies.WINDOW) == 1
    assert 5 < vector_copies.passes(50_000) < vector_copies.passes(10**9) < 80


def test_pairs_just_above_the_threshold_are_met(spark):
    random = np.random.default_rng(2)
    rows = []
    for i in range(300):  # pairs at a cosine of 0.951, far from everything else
        a, b = random.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a), (2 * i + 1, 0.951 * a + math.sqrt(1 - 0.951**2) * b)]
    found = vector_copies.near_copies(embeddings(spark, rows), window=32, block=128)
    assert found.filter("not kept").count() >= 0.99 * 300
