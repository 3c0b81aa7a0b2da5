import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tradewind.operators import clusters, ranking, skew
from tradewind.operators.histogram import histogram
from tradewind.operators.latest import latest_per_key
from tradewind.operators.least_squares import solve_per_group
from tradewind.operators.quantiles import median, quantiles
from tradewind.operators.ranking import average_precision, global_rank, rank_auc, running_totals, value_counts
from tradewind.operators.sampling import keyed_sample
from tradewind.plans.segments import quantile_bin


@pytest.fixture
def many_buckets(monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 5)


def tied_frame(n=600, seed=1):
    r = np.random.default_rng(seed)
    values = np.where(r.random(n) < 0.35, 7.0, np.round(r.normal(0, 20, n), 1))  # a third share one value
    return pd.DataFrame({"id": range(n), "g": r.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "v": values,
                         "y": r.random(n) < 0.3})


@pytest.mark.parametrize("group", [[], ["g"]])
def test_running_totals_match_a_full_sort(spark, many_buckets, group):
    pdf = tied_frame()
    ranked = running_totals(value_counts(spark.createDataFrame(pdf), "v", group), "v", ["n"], group).toPandas()
    grouped = pdf.groupby(group)["v"] if group else pdf["v"]
    pdf["mid"] = grouped.rank()
    expected = {tuple(k): r for k, r in pdf.set_index([*group, "v"])["mid"].items()} if group else dict(
        zip(pdf["v"], pdf["mid"]))
    for row in ranked.itertuples():
        key = (row.g, row.v) if group else row.v
        assert row.before_n + (row.n + 1) / 2 == expected[key]


def test_running_totals_descending(spark, many_buckets):
    pdf = tied_frame()
    ranked = running_totals(value_counts(spark.createDataFrame(pdf), "v"), "v", ["n"], descending=True).toPandas()
    for row in ranked.itertuples():
        assert row.before_n == (pdf["v"] > row.v).sum()


def test_auc_and_average_precision_match_definitions(spark, many_buckets):
    pdf = tied_frame(400, 3)
    df = spark.createDataFrame(pdf)
    pos, neg = pdf[pdf.y]["v"].to_numpy(), pdf[~pdf.y]["v"].to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert rank_auc(df, "v", "y").first().roc_auc == pytest.approx(wins / (len(pos) * len(neg)))
    ap, before = 0.0, 0.0
    for t in sorted(set(pdf["v"]), reverse=True):
        chosen = pdf[pdf["v"] >= t]
        recall, precision = chosen.y.sum() / pdf.y.sum(), chosen.y.mean()
        ap, before = ap + (recall - before) * precision, recall
    assert average_precision(df, "v", "y").first().average_precision == pytest.approx(ap)


def test_global_rank_is_a_permutation_in_value_order(spark, many_buckets):
    pdf = tied_frame()
    pdf.loc[5, "v"] = None
    ranked = global_rank(spark.createDataFrame(pdf), "v", "id", "place").toPandas()
    known = ranked[ranked["v"].notna()].sort_values("place")
    assert known["place"].tolist() == list(range(1, len(known) + 1)) and known["v"].is_monotonic_increasing
    assert ranked[ranked["v"].isna()]["place"].isna().all()


@pytest.mark.parametrize("group", [[], ["g"]])
def test_quantiles_interpolate(spark, many_buckets, group):
    pdf = tied_frame()
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    rows = quantiles(spark.createDataFrame(pdf), "v", probs, group).collect()
    assert len(rows) == len(probs) * (3 if group else 1)
    for r in rows:
        values = pdf[pdf["g"] == r.g]["v"] if group else pdf["v"]
        assert r["quantile"] == pytest.approx(np.percentile(values, 100 * r.prob))


def test_median_of_nothing_is_null(spark):
    assert median(spark.createDataFrame([(None,)], "v double"), "v").first().median is None


def test_quantiles_approximate(spark):
    df = spark.range(1001).withColumn("v", F.col("id").cast("double"))
    assert {r.prob: r["quantile"] for r in quantiles(df, "v", [0.25, 0.5], approximate=True).collect()} == {0.25: 250.0, 0.5: 500.0}


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0.5, 1, 9, 10, 99)] + [(None,)], "v double")
    rows = histogram(df, "v", 10, cap=10.0).orderBy("bin").collect()
    over = rows.pop()  # what lies above the cap is counted too
    assert over.bin == 10 and over.bin_start == 10 and over.bin_end > 10 and over.n > 0
    assert [r.n for r in rows] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    assert rows[0].bin_start == 0 and rows[-1].bin_end == 10
    same = histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in same] == [2, 0, 0, 0]


def test_lookup_join_spreads_a_hot_key_and_changes_nothing(spark):
    r = random.Random(5)
    facts = [(i, None if i % 50 == 0 else (7 if i % 3 == 0 else r.randrange(200))) for i in range(3000)]
    left = spark.createDataFrame(facts, "id int, k int").repartition(3)
    right = spark.createDataFrame([(k, f"name {k}") for k in range(150)], "k int, name string")
    got = {row.id: row.name for row in skew.lookup_join(left, right, "k").collect()}
    assert got == {i: (f"name {k}" if k is not None and k < 150 else None) for i, k in facts}
    inner = skew.lookup_join(left, right, "k", "inner").count()
    assert inner == sum(1 for _, k in facts if k is not None and k < 150)


def test_latest_per_key_puts_null_first(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 5, "c"), (2, None, "d")], "k int, t int, v string")
    assert {r.k: r.v for r in latest_per_key(df, "k", ["t", "v"], ["v"]).collect()} == {1: "c", 2: "d"}


def test_keyed_sample_is_repeatable_and_of_the_right_size(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 10, "few").otherwise("many"))
    one = {(r.g, r.id) for r in keyed_sample(df, 50, ["g"], "id", 42).collect()}
    two = {(r.g, r.id) for r in keyed_sample(df.repartition(7), 50, ["g"], "id", 42).collect()}
    assert one == two and len(one) == 60
    assert one != {(r.g, r.id) for r in keyed_sample(df, 50, ["g"], "id", 43).collect()}


def test_keyed_sample_beyond_the_group_limit_is_the_same_sample(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 10, "few").otherwise("many"))
    small = {(r.g, r.id, r.place) for r in keyed_sample(df, 1500, ["g"], "id", 42, rank="place").collect()}
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2000")
    try:
        windowed = {(r.g, r.id, r.place) for r in keyed_sample(df, 1500, ["g"], "id", 42, rank="place").collect()}
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert small == windowed and len(small) == 1510


def test_least_squares_per_group(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 2))
    y = 3 + x @ [2.0, -1.0] + r.normal(0, 0.1, 200)
    pdf = pd.DataFrame({"g": ["a", "b"] * 100, "one": 1.0, "x1": x[:, 0], "x2": x[:, 1], "y": y})
    for row in solve_per_group(spark.createDataFrame(pdf), ["g"], ["one", "x1", "x2"], "y", [0, 0, 0]).collect():
        part = pdf[pdf.g == row.g]
        design = part[["one", "x1", "x2"]].to_numpy()
        beta, rest, *_ = np.linalg.lstsq(design, part["y"].to_numpy(), rcond=None)
        assert row.beta == pytest.approx(beta.tolist(), rel=1e-6)
        assert row.sigma == pytest.approx(float(np.sqrt(rest[0] / (len(part) - 3))), rel=1e-6)


def planted(spark, partitions=4):
    r = np.random.default_rng(0)
    points = np.concatenate([r.normal(c, 0.05, (60, 2)) for c in ([0, 0], [5, 5], [0, 5])])
    df = spark.createDataFrame(pd.DataFrame({"id": range(180), "x": points[:, 0], "y": points[:, 1]}))
    return df.repartition(partitions, "id")


def test_kmeans_finds_planted_clusters_for_several_k(spark):
    df = planted(spark)
    best = clusters.best_kmeans(df, ["x", "y"], ["id"], [2, 3], restarts=4, seed=42)
    assert best[3].cost < best[2].cost and best[3].cost < 2.0 and best[3].rested
    assert best[3].sizes.tolist() == [60, 60, 60]
    labels = [r.c for r in df.select("id", best[3].nearest(["x", "y"]).alias("c")).orderBy("id").collect()]
    assert [len(set(labels[i:i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(labels)) == 3


def test_kmeans_does_not_depend_on_partitions(spark):
    fits = [clusters.best_kmeans(planted(spark, n), ["x", "y"], ["id"], [3, 5], restarts=3, seed=7) for n in (1, 16)]
    for k in (3, 5):
        assert np.allclose(fits[0][k].centers, fits[1][k].centers, atol=1e-9)
        assert fits[0][k].sizes.tolist() == fits[1][k].sizes.tolist()


def test_kmeans_and_silhouettes_against_mllib(spark):
    """A blurred cloud: costs at most 0.1 % above MLlib's best of as many starts, silhouettes the same number."""
    r = np.random.default_rng(3)
    frame = pd.DataFrame(r.normal(0, 1, (1500, 3)) + r.integers(0, 3, (1500, 1)), columns=["x", "y", "z"]).assign(id=range(1500))
    df, names = spark.createDataFrame(frame).repartition(3, "id").cache(), ["x", "y", "z"]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    best = clusters.best_kmeans(df, names, ["id"], [3, 6], restarts=5, seed=1)
    scores = clusters.silhouettes(df, names, ["id"], best)
    for k, fit in best.items():
        theirs = min(KMeans(k=k, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(5))
        assert fit.cost <= theirs * 1.001
        assigned = vectors.withColumn("prediction", fit.nearest(names))
        assert scores[k] == pytest.approx(ClusteringEvaluator(metricName="silhouette").evaluate(assigned), abs=1e-9)
        gaps = ((frame[names].to_numpy()[:, None] - fit.centers) ** 2).sum(2).min(1).sum()
        assert fit.cost == pytest.approx(gaps, rel=1e-9)


def test_kmeans_passes_do_not_grow_with_the_models(spark, monkeypatch):
    passes, fold = [], clusters._folded
    monkeypatch.setattr(clusters, "_folded", lambda *a: passes.append(1) or fold(*a))
    df = planted(spark)
    counts = []
    for restarts in (1, 12):
        passes.clear()
        clusters.best_kmeans(df, ["x", "y"], ["id"], [2, 3, 4], restarts=restarts, seed=5, max_passes=4)
        counts.append(len(passes))
    assert max(counts) <= 1 + clusters.START_ROUNDS + 1 + 4 + 1


def test_kmeans_gives_a_rare_cluster_its_own_centre(spark):
    near = spark.range(20_000).selectExpr("id", "pmod(xxhash64(id), 1000) / 1000 as x", "pmod(xxhash64(id, 1), 1000) / 1000 as y")
    rare = spark.createDataFrame([(-1, 500.0, 500.0), (-2, 500.1, 500.0)], "id long, x double, y double")
    fit = clusters.best_kmeans(near.unionByName(rare), ["x", "y"], ["id"], [2], restarts=2, seed=1)[2]
    assert min(fit.sizes) == 2


def test_kmeans_of_few_or_no_rows(spark):
    same = spark.range(50).selectExpr("id", "1.0D as x")
    fit = clusters.best_kmeans(same, ["x"], ["id"], [3], restarts=2, seed=1)[3]
    assert fit.centers.tolist() == [[1.0]] and fit.sizes.tolist() == [50] and fit.cost == 0 and fit.rested
    assert np.isnan(clusters.silhouettes(same, ["x"], ["id"], {3: fit})[3])
    assert clusters.best_kmeans(same.limit(0), ["x"], ["id"], [3], restarts=2, seed=1) == {}
    assert clusters.silhouettes(same, ["x"], ["id"], {}) == {}


def test_kmeans_says_when_it_was_cut_short(spark):
    df = spark.range(500).selectExpr("id", "pmod(xxhash64(id), 997) / 1.0D as x", "id / 1.0D as y")
    assert not clusters.best_kmeans(df, ["x", "y"], ["id"], [8], restarts=1, seed=1, max_passes=1)[8].rested


def qcut(values, bins):
    try:
        return pd.qcut(values, bins, labels=range(1, bins + 1)).astype(float)
    except ValueError:
        return None


def test_quantile_bins_match_pandas(spark):
    values = pd.Series(range(100), dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(100), "v": values}))
    got = quantile_bin(df, "v", "id", "b").orderBy("id").toPandas()["b"].astype(float)
    assert got.tolist() == qcut(values, 5).tolist()


def test_quantile_bins_with_ties_cut_places(spark):
    values = [1.0] * 97 + [float(v) for v in range(2, 12)]
    df = spark.createDataFrame(pd.DataFrame({"id": range(107), "v": values}))
    got = quantile_bin(df, "v", "id", "b").toPandas()
    assert got["b"].notna().all() and got["b"].value_counts().sort_index().tolist() == [22, 21, 21, 21, 22]
    assert got.groupby("b")["v"].max().is_monotonic_increasing
