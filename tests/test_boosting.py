"""Functional boosting: Newton leaves, stop, sampling, missing values, and its margin over the linear model."""

import numpy as np

from pyspark.sql import functions as F

from ordlab.operators import boosting as bo


def rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.integers(0, 30, n).astype(float), rng.normal(size=n)
    y = np.clip(np.round(1 + x / 5 + (x > 15) * np.sign(z) + rng.normal(0, 0.4, n)), 1, 8)
    return [(i, None if i % 50 == 0 else float(a), float(b), float(c), bool(i % 4 == 0)) for i, (a, b, c) in enumerate(zip(x, z, y))]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, x double, z double, y double, valid boolean")


def apply(node, r):
    while isinstance(node, bo.Split):
        v = r[node.feature]
        node = node.left if v is not None and v <= node.threshold else node.right
    return node.value


def test_leaves_are_newton_steps_and_scores_add_up(spark):
    data = rows()
    df = frame(spark, data)
    m = bo.boost(df, ["x", "z"], "y", "id", "pseudo_huber", rounds=3, rate=0.5, depth=2)
    recs = [dict(zip(("id", "x", "z", "y"), r)) for r in data]
    s = np.zeros(len(recs))
    y = np.array([r["y"] for r in recs])
    for tree in m.trees:
        d = s - y
        g, h = d / np.sqrt(0.81 + d * d), 0.81 * (0.81 + d * d) ** -1.5
        leaf = np.array([apply(tree, r) for r in recs])
        for v in set(leaf):  # each leaf holds -sum g / sum h of its rows
            assert abs(v + g[leaf == v].sum() / h[leaf == v].sum()) < 1e-6 * max(1.0, abs(v))
        s = s + 0.5 * leaf
    got = {r.id: r.s[0] for r in m.score(df).collect()}
    assert max(abs(got[i] - v) for i, v in enumerate(s)) < 1e-9


def test_holdout_stops_and_best_round_counts(spark):
    values = iter([3.0, 2.0, 2.5, 2.6, 2.7, 1.0])
    m = bo.boost(frame(spark, rows(200)), ["x"], "y", "id", "squared", rounds=6, depth=1, valid="valid", hook=lambda d: next(values), patience=3)
    assert (m.best_round, len(m.trees)) == (2, 5)
    assert len(set(m.score(frame(spark, rows(200))).select(F.col("s")[0]).toPandas().iloc[:, 0])) <= 4  # two stumps


def test_own_objective_with_two_outputs_samples_and_no_rows(spark):
    def two(df, id_col, y, s):
        t = F.explode(F.array(F.struct(F.lit(1).alias("k"), (F.col(s)[0] - F.col(y)).alias("grad")),
                              F.struct(F.lit(2).alias("k"), (F.col(s)[1] + F.col(y)).alias("grad")))).alias("t")
        return df.select(id_col.alias("id"), t).select("id", "t.*", F.lit(1.0).alias("hess"))

    df = frame(spark, rows())
    m = bo.boost(df, ["x", "z"], "y", "id", two, n_outputs=2, rounds=4, rate=0.8, depth=4, row_share=0.8, feature_share=0.7)
    out = m.score(df).select((F.col("s")[0] - F.col("y")).alias("a"), (F.col("s")[1] + F.col("y")).alias("b"), "y").toPandas()
    assert out["a"].std() < 0.75 * out["y"].std() and out["b"].std() < 0.75 * out["y"].std()
    assert bo.boost(df.limit(0), ["x"], "y", "id").trees == []


def test_boosted_kappas_beat_the_linear_model(spark):
    from ordlab.plans.boosting import q_boost_softkappa
    k = {r.model: r.kappa for r in q_boost_softkappa(spark, "/root/testdata/sf0.01").collect()}
    assert k["boosted_softkappa"] > k["linear_softkappa"] + 0.02
    assert k["boosted_cocr"] > k["linear_softkappa"] + 0.1
