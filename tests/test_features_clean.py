"""Encoders, derived features, fills and imputers (FIXTURES C: cats, nulls)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordlab.operators import clean
from ordlab.operators import features as fe
from ordlab.operators.profile import null_profile


@pytest.fixture
def cats(spark):
    train = [(1, "b", 1.0), (2, "a", 2.0), (3, "b", 4.0), (4, "c", 8.0)]
    test = [(5, "a", None), (6, "z", None)]
    d = [(i, c, y, "train") for i, c, y in train] + [(i, c, y, "test") for i, c, y in test]
    return spark.createDataFrame(d, "id long, c string, y double, split string")


def test_label_encode_dense_and_per_split(spark, cats):
    codes = {r["c"]: r["c_code"] for r in fe.label_encode(cats, "c").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2, "z": 3}
    per = {(r["split"], r["c"]): r["c_code"] for r in fe.label_encode(cats, "c", per_split="split").collect()}
    assert per[("test", "a")] == 0 and per[("test", "z")] == 1 and per[("train", "c")] == 2
    # the large-level path (scalable position) gives the same codes
    big = {r["c"]: r["c_code"] for r in fe.label_encode(cats, "c").collect()}
    assert big == codes


def test_one_hot_unseen_is_zero(spark, cats):
    levels = fe.one_hot_levels(cats.filter("split = 'train'"), ["c"])
    out = fe.one_hot(cats, ["c"], levels=levels, sep="=")
    assert set(out.columns) >= {"c=a", "c=b", "c=c"} and "c=z" not in out.columns
    z = out.filter("id = 6").first()
    assert (z["c=a"], z["c=b"], z["c=c"]) == (0, 0, 0)


def test_target_encode_matches_pandas_restatement(spark, cats):
    got = {r["id"]: r["c_te"] for r in fe.target_encode_loo(cats, "c", "y", F.col("split") == "train").collect()}
    pdf = cats.toPandas()
    tr = pdf[pdf.split == "train"]
    pb = tr.y.mean()
    cnt = pdf.c.map(tr.c.value_counts()).fillna(0)
    csm = pdf.c.map(tr.groupby("c").y.sum()).fillna(pb)
    is_tr = pdf.split == "train"
    cnt[is_tr] -= 1
    csm[is_tr] -= pdf.y[is_tr]
    want = ((csm + pb * 15) / (cnt + 15)).fillna(pb)
    for i, w in zip(pdf.id, want):
        assert got[i] == pytest.approx(w)
    assert got[6] == pytest.approx(16 / 15 * pb)  # Q9: unseen category


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 3.0, True), (3, 5.0, False)], "id long, x double, tr boolean")
    z = {r["id"]: r["x_z"] for r in fe.standardize(df, ["x"], fit_on=F.col("tr"), suffix="_z").collect()}
    assert z[1] == pytest.approx(-1.0) and z[2] == pytest.approx(1.0) and z[3] == pytest.approx(3.0)


def test_woe(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("b", 0)], "c string, t int")
    w = {r["c"]: r["c_woe"] for r in fe.woe_encode(df, "c", "t").collect()}
    n1 = {"a": 2.5, "b": 0.5}
    n0 = {"a": 1.5, "b": 1.5}
    for k in w:
        assert w[k] == pytest.approx(np.log((n1[k] / 3.0) / (n0[k] / 3.0)))


def test_pair_and_body_features_guarded(spark):
    df = spark.createDataFrame([(2.0, 0.0), (3.0, 4.0)], "a double, b double")
    r = fe.pair_features(df, "a", "b", "p").orderBy("a").collect()
    assert r[0]["p_4"] == 0.0 and r[0]["p_5"] == 0.0 and r[1]["p_4"] == pytest.approx(0.75)
    b = fe.body_features(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0.0)], "h double, w double, m double, a double, d double"),
                         "h", "w", "m", "a", "d").first()
    assert b["Wt_Age"] == -2.0 and b["BMI_H32"] == 0.0 and b["scale"] == pytest.approx(0.0061 + 0.0256)


def test_row_sums(spark):
    df = spark.createDataFrame([(1, None, 2), (1, 1, 1)], "x_a int, x_b int, y int")
    out = fe.count_features(fe.family_sums(df, ["x_"]), {"s": ["x_a", "x_b"]}).orderBy("y").collect()
    assert (out[0]["fam_x_"], out[0]["s"]) == (2, 2)
    assert (out[1]["fam_x_"], out[1]["s"]) == (1, None)


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame([(None, 1.0, 1.0), (None, None, 2.0), (None, 3.0, 3.0), (None, None, 4.0)],
                                 "a double, b double, c double")


def test_null_profile_and_fills(spark, nulls):
    p = {r["column"]: (r["null_rate"], r["flagged"]) for r in null_profile(nulls).collect()}
    assert p == {"a": (1.0, True), "b": (0.5, True), "c": (0.0, False)}
    m = [r["b"] for r in clean.fill_mean(nulls, ["b"]).collect()]
    assert m == [1.0, 2.0, 3.0, 2.0]
    md = [r["b"] for r in clean.fill_median(nulls, ["b"]).collect()]
    assert md == [1.0, 2.0, 3.0, 2.0]
    s = [r["b"] for r in clean.fill_sentinel(nulls, ["b"], -1).collect()]
    assert s == [1.0, -1.0, 3.0, -1.0]


def test_ridge_single_closed_form(spark):
    x = np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    y = np.array([2.0, 4.1, 5.9, 8.2, None], dtype=object)
    df = spark.createDataFrame([(float(a), (float(b) if b is not None else None)) for a, b in zip(x, y)],
                               "x double, y double")
    fit = clean.ridge_single_fit(df, "x", "y", 1.0).first()
    xs, ys = x[:4], np.array(y[:4], float)
    sxy = np.sum((xs - xs.mean()) * (ys - ys.mean()))
    sxx = np.sum((xs - xs.mean()) ** 2)
    assert fit["slope"] == pytest.approx(sxy / (sxx * 2.0))
    filled = clean.impute_ridge_single(df, "x", "y", 1.0, categorical=False).collect()[-1]["y_filled"]
    assert filled == pytest.approx(ys.mean() - fit["slope"] * xs.mean() + fit["slope"] * 5.0)


def test_ridge_multi_matches_normalised_ridge(spark):
    """V5: LinearRegression(regParam = alpha * std_pop(y), standardization) is
    the normalised ridge closed form."""
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 3))
    y = X @ np.array([1.0, -2.0, 0.5]) + rng.normal(scale=0.1, size=60)
    alpha = 0.5
    rows = [(i, *map(float, X[i]), float(y[i]) if i < 50 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    out = {r["id"]: r["y_filled"] for r in clean.impute_ridge_multi(df, ["a", "b", "c"], "y", alpha).collect()}
    Xk, yk = X[:50], y[:50]
    Xc = Xk - Xk.mean(0)
    nrm = np.sqrt((Xc ** 2).sum(0))
    Xn = Xc / nrm
    w = np.linalg.solve(Xn.T @ Xn + alpha * np.eye(3), Xn.T @ (yk - yk.mean())) / nrm
    b0 = yk.mean() - Xk.mean(0) @ w
    for i in range(50, 60):
        assert out[i] == pytest.approx(float(X[i] @ w + b0), rel=1e-6, abs=1e-6)
