"""Cut-point search, ensembles, votes, top-k and feature selection
(FIXTURES C: preds) against brute-force restatements."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordlab.operators import cutpoints as cp
from ordlab.operators import ensemble as en
from ordlab.operators import select as sel
from tests.test_metrics import dense_kappa


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(1, 9, 400)
    s = y + rng.normal(scale=1.2, size=400)
    return spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))],
                                 "id long, s double, y int"), s, y


def _cut(s, cuts):
    return 1 + (s[:, None] > np.array(cuts)[None, :]).sum(1)


def test_candidate_scores_vs_brute_force(scored):
    df, s, y = scored
    cands = [[1.5 + a + b * k for k in range(7)] for a in (-0.3, 0.0, 0.4) for b in (0.9, 1.0, 1.1)]
    cands.append([2.0, 2.0, 3.0, 4.5, 5.0, 6.0, 7.0])  # repeated cut value
    got = {r["cand"]: r["kappa"] for r in cp.score_candidates(df, "s", "y", cands).collect()}
    for i, cuts in enumerate(cands):
        assert got[i] == pytest.approx(dense_kappa(y, _cut(s, cuts), "quadratic"), abs=1e-12)


def test_fit_cutpoints_improves(scored):
    df, s, y = scored
    start = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    cuts, k = cp.fit_cutpoints(df, "s", "y", start, step=0.5, min_step=0.125)
    k0 = dense_kappa(y, _cut(s, start), "quadratic")
    assert k >= k0 - 1e-12
    assert k == pytest.approx(dense_kappa(y, _cut(s, cuts), "quadratic"), abs=1e-12)
    assert cuts == sorted(cuts)


def test_random_search_cutpoints(scored):
    df, s, y = scored
    cuts, k = cp.random_search_cutpoints(df, "s", "y", n_candidates=16, generations=2, seed=3)
    assert len(cuts) == 7 and k == pytest.approx(dense_kappa(y, _cut(s, cuts), "quadratic"), abs=1e-12)


def test_blend_equal_weights_is_mean(spark):
    preds = spark.createDataFrame([("m1", 1, 1.0), ("m2", 1, 3.0), ("m1", 2, 2.0), ("m2", 2, 6.0)],
                                  "model string, id long, prediction double")
    w = spark.createDataFrame([("m1", 1.0), ("m2", 1.0)], "model string, weight double")
    b = {r["id"]: r["blend"] for r in en.blend_weighted(preds, w).collect()}
    assert b == {1: 2.0, 2: 4.0}
    w2 = spark.createDataFrame([("m1", 3.0), ("m2", 1.0)], "model string, weight double")
    b2 = {r["id"]: r["blend"] for r in en.blend_weighted(preds, w2).collect()}
    assert b2[1] == pytest.approx(1.5)


def test_votes(spark):
    df = spark.createDataFrame([(1, 2, 2), (3, 1, 2), (5, 5, 5), (4, 6, 6)], "a int, b int, c int")
    r = df.select(en.vote_majority(["a", "b", "c"]).alias("m"), en.vote_agreement("a", "b", "c").alias("g")).collect()
    assert [x["m"] for x in r] == [2, 1, 5, 6]
    assert [x["g"] for x in r] == [2, 3, 5, 6]


def test_top_k_per_group_skewed(spark):
    rng = np.random.default_rng(11)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, float(rng.integers(0, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "model string, trial long, kappa double")
    got = en.top_k_per_group(df, ["model"], "kappa", 10, "trial", salt_buckets=8).collect()
    pdf = df.toPandas().sort_values(["model", "kappa", "trial"], ascending=[True, False, True])
    want = pdf.groupby("model").head(10)
    assert sorted((r["model"], r["trial"]) for r in got) == sorted(zip(want.model, want.trial))


def test_greedy_selection_improves(spark):
    rng = np.random.default_rng(4)
    n = 300
    y = rng.integers(1, 9, n)
    rows = []
    for m, noise in (("good", 0.8), ("ok", 1.5), ("bad", 4.0)):
        p = y + rng.normal(scale=noise, size=n)
        for run in (1, 2):
            rows += [(m, run, i, float(p[i]), int(y[i])) for i in range(n)]
    preds = spark.createDataFrame(rows, "model string, run int, id long, prediction double, target int")
    from ordlab.operators.profile import class_cdf
    cdf = class_cdf(preds.filter("model = 'good'"), "target", by=["run"])
    chosen = en.greedy_selection(preds, cdf, weights=(0.5, 1.0))
    assert chosen[0][1] == "good"
    ks = [c[3] for c in chosen]
    assert ks == sorted(ks)


def test_f_scores_vs_numpy(spark):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(200, 3))
    y = X[:, 0] * 2 + rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(v),) for r, v in zip(X, y)],
                               "a double, b double, c double, y double")
    got = {r["feature"]: r["f_score"] for r in sel.f_scores(df, ["a", "b", "c"], "y").collect()}
    for i, f in enumerate("abc"):
        r = np.corrcoef(X[:, i], y)[0, 1]
        assert got[f] == pytest.approx(r * r / (1 - r * r) * 198)
    keep = sel.percentile_keep(sel.f_scores(df, ["a", "b", "c"], "y"), [50, 100]).collect()
    assert sorted((r["pct"], r["feature"]) for r in keep)[0] == (50, "a")


def test_pair_mic_vs_numpy(spark):
    rng = np.random.default_rng(9)
    n = 120
    a = rng.normal(size=n)
    b = a ** 2 + 0.1 * rng.normal(size=n)
    c = rng.normal(size=n)
    df = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, c))],
                               "id long, a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["mic"] for r in sel.pair_mic(df, "id", ["a", "b", "c"]).collect()}

    def equal_bins(v, k):
        pos = np.empty(n, int)
        pos[np.lexsort((np.arange(n), v))] = np.arange(n)
        return pos * k // n

    def mic(u, v):
        best = 0.0
        for bx, by in [(2 ** x, 2 ** y) for x, y in sel.grid_levels(n)[1]]:
            x, yy = equal_bins(u, bx), equal_bins(v, by)
            j = np.zeros((bx, by))
            np.add.at(j, (x, yy), 1)
            pj = j / n
            px, py = pj.sum(1, keepdims=True), pj.sum(0, keepdims=True)
            nz = pj > 0
            mi = float(np.sum(pj[nz] * np.log(pj[nz] / (px @ py)[nz])))
            best = max(best, mi / math.log(min(bx, by)))
        return best

    assert got[("a", "b")] == pytest.approx(mic(a, b), abs=1e-9)
    assert got[("a", "c")] == pytest.approx(mic(a, c), abs=1e-9)
    assert got[("a", "b")] > got[("a", "c")]


def test_mrmr_greedy():
    class Rows:
        def __init__(self, rows):
            self.rows = rows

        def collect(self):
            return self.rows

    mic = {("x", "label"): 0.9, ("y", "label"): 0.85, ("z", "label"): 0.3,
           ("x", "y"): 0.8, ("x", "z"): 0.1, ("y", "z"): 0.1}
    rows = [{"feature_a": a, "feature_b": b, "mic": v} for (a, b), v in mic.items()]
    picks = sel.mrmr(Rows(rows), "label", n_select=2)
    assert [p[1] for p in picks] == ["x", "z"]
