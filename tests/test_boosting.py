"""Histogram boosting: the trees of a shard, the table of nodes and what must not change them."""

import numpy as np
import pytest

from tradewind.operators import boosting
from tradewind.operators.boosting import Settings

FEATURES = ["a", "b", "c"]


def rows(n=600, seed=4):
    random = np.random.default_rng(seed)
    x = np.round(random.standard_normal((n, 3)), 2)
    chance = 1 / (1 + np.exp(-(2 * (x[:, 0] > 0.3) + x[:, 1] * (x[:, 2] > 0) - 1)))
    return [(f"k{i}", *map(float, v), float(y), 1.0) for i, (v, y) in enumerate(zip(x, random.random(n) < chance))]


def table(spark, found):
    return spark.createDataFrame(found, "id string, a double, b double, c double, y double, w double")


def fitted(df, settings=Settings(rounds=10), **more):
    return boosting.fit(df, FEATURES, "y", "w", "id", settings, **more)


def losses(nodes, x, y, settings):
    """Log loss after each round, by walking the nodes of one ensemble."""
    out, margin = [], np.zeros(len(x))
    for number in range(settings.rounds):
        own = {r.node: r for r in nodes if r.round == number}
        for i, v in enumerate(x):
            at = 0
            while own[at].feature != boosting.LEAF:
                at = 2 * at + 1 + int(v[own[at].feature] > own[at].threshold)
            margin[i] += own[at].value
        p = 1 / (1 + np.exp(-margin))
        out.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    return out, margin


def test_loss_falls_every_round_and_scores_are_those_of_the_nodes(spark):
    found = rows(300)
    settings = Settings(rounds=15, row_share=1.1, column_share=1.0)  # every row is drawn
    model = fitted(table(spark, found), settings)
    x, y = np.array([r[1:4] for r in found]), np.array([r[4] for r in found])
    out, margin = losses(model.collect(), x, y, settings)
    assert all(b < a for a, b in zip([np.log(2), *out], out))
    scored = {r["id"]: r["p"] for r in boosting.scored(table(spark, found), model, FEATURES, "p").collect()}
    assert np.allclose([scored[r[0]] for r in found], 1 / (1 + np.exp(-margin)), atol=1e-12)


def test_a_leaf_is_the_newton_step_of_its_rows(spark):
    found = rows(300)
    settings = Settings(rounds=1, depth=2, rate=1.0, row_share=1.1, column_share=1.0)
    nodes = {r.node: r for r in fitted(table(spark, found), settings).collect()}
    for node, r in nodes.items():
        if r.feature == boosting.LEAF:
            own = found
            path = []
            while node:
                path.append((nodes[(node - 1) // 2], node % 2 == 0))
                node = (node - 1) // 2
            for parent, right in path:
                own = [v for v in own if (v[1 + parent.feature] > parent.threshold) == right]
            g = sum(0.5 - v[4] for v in own)
            assert r.value == pytest.approx(-g / (0.25 * len(own) + boosting.RIDGE))


def test_the_root_split_is_the_best_of_all(spark):
    found = rows(200)
    root = [r for r in fitted(table(spark, found), Settings(rounds=1, row_share=1.1, column_share=1.0)).collect() if r.node == 0][0]

    def gain(f, cut):
        parts = [[v for v in found if (v[1 + f] > cut) == side] for side in (False, True)]
        if min(map(len, parts)) * 0.25 < boosting.LEAST_HESSIAN:
            return 0.0
        score = [sum(0.5 - v[4] for v in p) ** 2 / (0.25 * len(p) + 1) for p in (*parts, found)]
        return score[0] + score[1] - score[2]

    best = max(gain(f, (a + b) / 2) for f in range(3) for col in [sorted({v[1 + f] for v in found})] for a, b in zip(col, col[1:]))
    assert root.gain == pytest.approx(best) and gain(root.feature, root.threshold) == pytest.approx(best)


def test_model_does_not_depend_on_partitions(spark):
    df = table(spark, rows())

    def nodes(d):
        return sorted(tuple(r) for r in fitted(d, shard_rows=250).collect())

    one = nodes(df.repartition(1))
    assert one == nodes(df.repartition(64)) and len({r[0] for r in one}) == 3


def test_shards_are_bounded_and_a_large_table_is_sampled_by_hash(spark):
    model = fitted(table(spark, rows(2_000)), Settings(rounds=1), shard_rows=100, most_shards=4)
    root = model.filter("node = 0").collect()
    assert len(root) == 4
    assert all(r.cover < 0.25 * 160 for r in root)  # about 100 rows each, not 500


def test_ranks_like_another_implementation(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tradewind.operators.ranking import rank_auc

    train, test = table(spark, rows(1_500)), table(spark, rows(1_500, seed=5))
    ours = boosting.scored(test, fitted(train, Settings(rounds=30, rate=0.2, depth=3)), FEATURES, "p")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x")
    theirs = GBTClassifier(featuresCol="x", labelCol="y", maxIter=15, maxDepth=3, stepSize=0.2, seed=1).fit(vectors.transform(train))
    other = theirs.transform(vectors.transform(test)).select("y", vector_to_array("probability")[1].alias("p"))
    auc = [rank_auc(d.selectExpr("p", "y = 1 as y"), "p", "y").first()["roc_auc"] for d in (ours, other)]
    assert auc[0] > 0.7 and auc[0] > auc[1] - 0.02


def test_constant_features_and_importances(spark):
    found = [(f"k{i}", 1.0, 1.0, 1.0, float(i % 2), 1.0) for i in range(20)]
    model = fitted(table(spark, found), Settings(rounds=2))
    assert boosting.importances(model, FEATURES) == [0.0, 0.0, 0.0]
    assert {r["p"] for r in boosting.scored(table(spark, found), model, FEATURES, "p").collect()} != set()
    shares = boosting.importances(fitted(table(spark, rows())), FEATURES)
    assert sum(shares) == pytest.approx(1) and max(shares) == shares[0]
