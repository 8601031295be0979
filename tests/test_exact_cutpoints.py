"""Exact cut points against all cut vectors, and against the searches."""

import itertools

import numpy as np

from ordlab.operators import cutpoints as cp


def qwk(y, k):
    n = len(y)
    e = n * (np.var(y) + np.var(k) + (np.mean(y) - np.mean(k)) ** 2)
    return None if e == 0 else 1 - np.sum((y - k) ** 2) / e


def classes(s, cuts):
    return 1 + sum((s > c).astype(int) for c in cuts)


def test_best_of_all_vectors():
    rng = np.random.default_rng(0)
    for trial in range(30):
        n_classes = int(rng.integers(2, 5))
        s = rng.integers(0, 9, 60).astype(float)
        y = np.clip(np.round(s / 3 + rng.normal(0, rng.uniform(0, 2), 60)), 1, n_classes + 1).astype(int)
        grid = np.unique(s)
        labels, code = np.unique(y, return_inverse=True)
        counts = np.zeros((len(grid) + 1, len(labels)))
        np.add.at(counts, (np.searchsorted(grid, s), code), 1)
        cuts, kappa = cp.best_cuts(counts, labels.astype(float), n_classes)
        values = np.array([grid[0] - 1, *grid])
        every = [qwk(y, classes(s, c)) for c in itertools.combinations_with_replacement(values, n_classes - 1)]
        assert abs(kappa - max(k for k in every if k is not None)) < 1e-12
        assert abs(qwk(y, classes(s, values[cuts])) - kappa) < 1e-12


def test_one_label():
    assert cp.best_cuts(np.array([[3.0], [4.0]]), np.array([2.0]), 3)[1] == 0.0
    assert cp.best_cuts(np.array([[3.0], [4.0]]), np.array([3.0]), 3)[1] is None  # all in the label's class


def scored(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    s = rng.uniform(0, 9, n)
    y = np.clip(np.round(s ** 1.1 - 1 + rng.normal(0, 1.5, n)), 1, 8).astype(int)
    rows = [(i % 2, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))] + [(0, None, 3), (1, float("nan"), 4), (1, 2.0, None)]
    return spark.createDataFrame(rows, "run int, s double, y int"), s, y


def test_never_below_the_searches(spark):
    df, s, y = scored(spark)
    out = cp.exact_cutpoints(df, "s", "y").orderBy("k").collect()
    cuts = [r.cut for r in out]
    assert len(cuts) == 7 and cuts == sorted(cuts)
    assert abs(qwk(y, classes(s, cuts)) - out[0].kappa) < 1e-9
    full = df.dropna().filter("not isnan(s)")
    assert out[0].kappa >= cp.fit_cutpoints(full, "s", "y", [1.5 + j for j in range(7)], min_step=0.1)[1] - 1e-12
    assert out[0].kappa >= cp.random_search_cutpoints(full, "s", "y", n_candidates=40, generations=3)[1] - 1e-12


def test_groups_and_refinement(spark):
    df, s, y = scored(spark)
    exact = {(r.run, r.k): r for r in cp.exact_cutpoints(df, "s", "y", by=["run"]).collect()}
    assert len(exact) == 14
    for run in (0, 1):
        m = np.arange(len(s)) % 2 == run
        assert abs(qwk(y[m], classes(s[m], [exact[(run, k)].cut for k in range(1, 8)])) - exact[(run, 1)].kappa) < 1e-9
    coarse = cp.exact_cutpoints(df, "s", "y", max_bins=60).collect()
    best = cp.exact_cutpoints(df, "s", "y").collect()[0].kappa
    first = cp.exact_cutpoints(df, "s", "y", grid=sorted(np.quantile(s, np.linspace(0, 1, 60)))).collect()[0].kappa
    assert first - 1e-12 <= coarse[0].kappa <= best + 1e-12 and coarse[0].kappa > best - 2e-3


def test_no_rows(spark):
    empty = spark.createDataFrame([], "s double, y int")
    assert cp.exact_cutpoints(empty, "s", "y").collect() == []
