"""Trees on random thresholds, and encoders without a cap on levels."""

import numpy as np

from ordlab.operators import features as fe
from ordlab.operators.boosting import Split
from ordlab.operators.extra_trees import extra_trees


def splits(node):
    return [(node.feature, node.threshold), *splits(node.left), *splits(node.right)] if isinstance(node, Split) else []


def value(node, r):
    while isinstance(node, Split):
        v = r[node.feature]
        node = node.left if v is not None and v <= node.threshold else node.right
    return node.value


def test_thresholds_are_drawn_and_forest_beats_the_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 3, (500, 3))
    y = np.sin(2 * x[:, 0]) * 2 + (x[:, 1] > 0.5) + rng.normal(0, 0.1, 500)
    recs = [dict(id=i, a=None if i == 3 else float(p[0]), b=float(p[1]), c=1.0, y=float(v)) for i, (p, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame([tuple(r.values()) for r in recs], "id long, a double, b double, c double, y double")
    m = extra_trees(df, ["a", "b", "c"], "y", trees=6, cuts=12, depth=6, feature_share=0.7)
    assert len(m.trees) == 6 and m.cuts[0]["a"] != m.cuts[1]["a"] and m.cuts[0]["c"] == []
    for tree, cuts in zip(m.trees, m.cuts):
        used = splits(tree)
        assert used and all(t in cuts[f] for f, t in used)
        assert all(min(x[:, 0]) <= t <= max(x[:, 0]) for t in cuts["a"])
    got = {r.id: r.prediction for r in m.predict(df).collect()}
    assert all(abs(got[r["id"]] - np.mean([value(t, r) for t in m.trees])) < 1e-12 for r in recs)
    rmse = np.sqrt(np.mean([(got[r["id"]] - r["y"]) ** 2 for r in recs]))
    assert rmse < 0.6 * np.std(y)
    assert extra_trees(df.limit(0), ["a"], "y", trees=2).trees == []
    again = extra_trees(df, ["a", "b", "c"], "y", trees=6, cuts=12, depth=6, feature_share=0.7)
    assert [splits(t) for t in again.trees] == [splits(t) for t in m.trees]


def test_fifteen_hundred_levels(spark):
    df = spark.range(1500).selectExpr("id", "concat('v', lpad(cast(id as string), 4, '0')) as code")
    levels = fe.one_hot_levels(df, ["code"])["code"]
    assert len(levels) == 1500
    out = fe.one_hot(df.limit(3), ["code"], levels={"code": levels})
    assert len(out.columns) == 1501 and sum(out.first()[1:]) == 1


def test_codes_of_many_and_few_levels_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i * 7 % 13}", i % 2) for i in range(60)] + [(99, None, 0)], "id long, c string, s int")
    few = {r.id: r.c_code for r in fe.label_encode(df, "c", per_split="s").collect()}
    monkeypatch.setattr(fe, "FEW_LEVELS", 2)
    many = {r.id: r.c_code for r in fe.label_encode(df, "c", per_split="s").collect()}
    assert few == many and few[99] is None and set(few.values()) - {None} <= set(range(13))
