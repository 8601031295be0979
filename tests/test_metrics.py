"""Kappa family and error metrics against a numpy restatement of the dense
rating-matrix definitions (FIXTURES C: ratings)."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordlab.operators import metrics as mt


def dense_kappa(a, b, weight):
    a, b = np.asarray(a, int), np.asarray(b, int)
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    k = hi - lo + 1
    o = np.zeros((k, k))
    for x, y in zip(a, b):
        o[x - lo, y - lo] += 1
    ha, hb = o.sum(1), o.sum(0)
    n = len(a)
    num = den = 0.0
    for i in range(k):
        for j in range(k):
            if weight == "quadratic":
                d = (i - j) ** 2 / (k - 1) ** 2 if k > 1 else float("nan")
            elif weight == "linear":
                d = abs(i - j) / (k - 1) if k > 1 else float("nan")
            else:
                d = 0.0 if i == j else 1.0
            num += d * o[i, j] / n
            den += d * ha[i] * hb[j] / n / n
    return 1.0 - num / den if den else None


FN = {"quadratic": mt.qwk, "linear": mt.linear_kappa, "unweighted": mt.cohen_kappa}


def _kappa(spark, a, b, kind):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    return FN[kind](df, "a", "b").first()["kappa"]


@pytest.mark.parametrize("kind", ["quadratic", "linear", "unweighted"])
def test_identical_raters_give_one(spark, kind):
    a = [1, 2, 3, 4, 5, 6, 7, 8, 3, 3]
    assert _kappa(spark, a, a, kind) == pytest.approx(1.0)


@pytest.mark.parametrize("kind", ["quadratic", "linear", "unweighted"])
def test_reversed_raters_negative(spark, kind):
    a = list(range(1, 9))
    assert _kappa(spark, a, a[::-1], kind) < 0


def test_constant_rater_null(spark):
    assert _kappa(spark, [3, 3, 3], [3, 3, 3], "quadratic") is None


@pytest.mark.parametrize("kind", ["quadratic", "linear", "unweighted"])
def test_gap_in_range_matches_dense(spark, kind):
    a = [1, 2, 2, 8, 8, 5, 1, 2]
    b = [2, 2, 1, 8, 7, 5, 1, 8]
    assert _kappa(spark, a, b, kind) == pytest.approx(dense_kappa(a, b, kind), abs=1e-12)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(1, 8)), min_size=3, max_size=60))
def test_kappa_property_vs_dense(spark, pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for kind in FN:
        want = dense_kappa(a, b, kind)
        got = _kappa(spark, a, b, kind)
        if want is None or (isinstance(want, float) and math.isnan(want)):
            assert got is None or math.isnan(got)
        else:
            assert got == pytest.approx(want, abs=1e-9)


def test_qwk_symmetric_and_grouped(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 9, 200).tolist(), rng.integers(1, 9, 200).tolist()
    g = [i % 3 for i in range(200)]
    df = spark.createDataFrame(list(zip(g, a, b)), "g int, a int, b int")
    k1 = {r["g"]: r["kappa"] for r in mt.qwk(df, "a", "b", by=["g"]).collect()}
    k2 = {r["g"]: r["kappa"] for r in mt.qwk(df, "b", "a", by=["g"]).collect()}
    for key in k1:
        sel = [i for i in range(200) if g[i] == key]
        assert k1[key] == pytest.approx(k2[key])
        assert k1[key] == pytest.approx(dense_kappa([a[i] for i in sel], [b[i] for i in sel], "quadratic"))


def test_confusion_zero_filled(spark):
    df = spark.createDataFrame([(1, 1), (3, 3), (3, 1)], "a int, b int")
    cm = {(r["a"], r["b"]): r["n"] for r in mt.confusion(df, "a", "b").collect()}
    assert len(cm) == 9 and cm[(2, 2)] == 0 and cm[(3, 1)] == 1 and sum(cm.values()) == 3


def test_rating_hist_zero_filled(spark):
    df = spark.createDataFrame([(1,), (1,), (8,)], "r int")
    h = {r["rating"]: r["n"] for r in mt.rating_hist(df, "r", lo=1, hi=8).collect()}
    assert h == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1}


def test_mean_kappa_z(spark):
    ks, ws = [0.2, 0.5, 1.0], [1.0, 2.0, 3.0]
    df = spark.createDataFrame(list(zip(ks, ws)), "kappa double, w double")
    got = mt.mean_kappa_z(df, "kappa", "w").first()[0]
    k = np.clip(np.array(ks), -0.999, 0.999)
    w = np.array(ws) / np.mean(ws)
    z = np.mean(0.5 * np.log((1 + k) / (1 - k)) * w)
    assert got == pytest.approx((np.exp(2 * z) - 1) / (np.exp(2 * z) + 1))


def test_auc_with_ties_vs_brute_force(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(size=300) + y, 1)  # many ties
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "id long, y int, s double")
    got = mt.auc(df, "y", "s", "id").first()[0]
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got == pytest.approx(want)


def test_regression_errors_and_accuracy(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 5.0)], "y double, p double")
    r = mt.regression_errors(df, "y", "p").first()
    d = np.array([0.5, 0.0, 2.0])
    assert r["mse"] == pytest.approx(np.mean(d ** 2)) and r["mae"] == pytest.approx(np.mean(np.abs(d)))
    assert r["rmse"] == pytest.approx(math.sqrt(np.mean(d ** 2)))
    assert mt.accuracy(df, "y", "p").first()[0] == pytest.approx(2 / 3)


def test_error_pairs(spark):
    df = spark.createDataFrame([(8, 7), (8, 7), (1, 1), (2, 3)], "raw int, pred int")
    got = {r["key"]: r["value"] for r in mt.error_pairs(df, "raw", "pred").collect()}
    assert got == {"8:7": 2, "2:3": 1}
