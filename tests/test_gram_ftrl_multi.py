"""Add-one fits from one Gram table, and the multiclass FTRL state, against plain restatements."""

import numpy as np

from pyspark.sql import functions as F

from ordlab.operators import ftrl_multi as fm
from ordlab.operators import tune
from ordlab.operators.ftrl import FtrlParams


def test_bordered_fits_equal_single_fits(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 4)) @ rng.normal(size=(4, 4)) + 5
    x[:, 3] = 2 * x[:, 0] - x[:, 1]  # determined by the base set
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(0, 0.1, 240)
    rows = [(i, *map(float, r), None if i == 7 else float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")
    folds = spark.createDataFrame([(r, i, "train" if (i + r) % 3 else "test") for r in (1, 2) for i in range(240)], "run int, id long, role string")
    fits = tune.add_one_fits(tune.gram_table(df, folds, list("abcd"), "y", "id"), list("abcd"), ["a", "b"], ["c", "d"])
    assert len(fits) == 4
    for run, cand, icept, coef in fits:
        use = [i for i in range(240) if (i + run) % 3 and i != 7]
        cols = [0, 1] + ([2] if cand == "c" else [])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(use)), x[np.ix_(use, cols)]]), y[use], rcond=None)[0]
        got = [icept, coef["a"], coef["b"]] + ([coef["c"]] if cand == "c" else [])
        assert np.allclose(got, want, atol=1e-6) and (cand == "c" or coef["d"] == 0.0)


def test_forward_test_equals_single_scores(spark):
    from ordlab.operators.decode import decode_cut
    from ordlab.operators.metrics import qwk
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = np.clip(np.round(4 + 1.5 * x[:, 0] + 1.0 * x[:, 1]), 1, 8)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    folds = spark.createDataFrame([(r, i, "train" if (i + r) % 4 else "test") for r in (1, 2) for i in range(300)], "run int, id long, role string")
    cuts = [k + 0.5 for k in range(1, 8)]
    got = {r.feature: r for r in tune.forward_linear_test(df, folds, ["a"], ["b", "c"], "y", "id", cuts).collect()}
    for j, name in ((1, "b"), (2, "c")):
        ks = []
        for run in (1, 2):
            tr = [i for i in range(300) if (i + run) % 4]
            w = np.linalg.lstsq(np.column_stack([np.ones(len(tr)), x[np.ix_(tr, [0, j])]]), y[tr], rcond=None)[0]
            te = [i for i in range(300) if not (i + run) % 4]
            p = spark.createDataFrame([(int(y[i]), float(w[0] + x[i, 0] * w[1] + x[i, j] * w[2])) for i in te], "y int, s double")
            ks.append(qwk(p.withColumn("c", decode_cut("s", cuts)), "y", "c").first()[0])
        assert abs(got[name].kappa_mean - np.mean(ks)) < 1e-9 and abs(got[name].kappa_std - np.std(ks)) < 1e-9
    assert got["b"].kappa_mean > got["c"].kappa_mean + 0.1


def test_multiclass_fit_equals_numpy(spark):
    rng = np.random.default_rng(4)
    n, k, feats = 60, 3, [f"f{j}" for j in range(5)]
    x = rng.normal(size=(n, 5)) * (rng.random((n, 5)) < 0.7)
    y = 1 + np.argmax(x[:, :3] + rng.normal(0, 0.2, (n, 3)), 1)
    w = rng.integers(1, 4, n).astype(float)
    long = spark.createDataFrame([(i, feats[j], float(x[i, j])) for i in range(n) for j in range(5) if x[i, j]], "id long, feature string, value double")
    labels = spark.createDataFrame([(i, int(y[i]), float(w[i])) for i in range(n)], "id long, y int, weight double")
    prm = FtrlParams(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    state, history = fm.fit(long, labels, prm, [1, 2, 3], batch_size=20, epochs=2, weight="weight", valid_long=long, valid_labels=labels)
    z, m, c = np.zeros((5, k)), np.zeros((5, k)), np.zeros((5, k))
    acc = []
    best = None
    for _ in range(2):
        for b in range(0, n, 20):
            has = (x[b:b + 20] != 0).any(1)
            xb, yb, wb = x[b:b + 20][has], y[b:b + 20][has], w[b:b + 20][has]
            p = 1 / (1 + np.exp(-np.clip(xb @ c, -35, 35)))
            g = xb.T @ (wb[:, None] * (p - (yb[:, None] == np.array([1, 2, 3]))))
            z = z + g - (np.sqrt(m + g * g) - np.sqrt(m)) / 0.5 * c
            m = m + g * g
            c = np.where(np.abs(z) <= 0.1, 0, (np.sign(z) * 0.1 - z) / ((1 + np.sqrt(m)) / 0.5 + 0.2))
        has = (x != 0).any(1)
        acc.append(float((1 + np.argmax(x[has] @ c, 1) == y[has]).mean()))
        if best is None or acc[-1] > best[0]:
            best = (acc[-1], c)
    assert np.allclose(history, acc)
    got = {r.feature: r.w for r in state.collect()}
    assert np.allclose([got[f] for f in feats], best[1], atol=1e-9)
    p = fm.probabilities(long, state, [1, 2, 3]).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.cls == 1 + int(np.argmax(r.p)) for r in p)
    assert fm.fit(long.limit(0), labels.limit(0), prm, [1, 2], 10)[0].collect() == []
