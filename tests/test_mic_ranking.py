"""MIC partition search and the all-pairs gradient against brute force."""

import itertools
import math

import numpy as np

from ordlab.operators import ranking as rk
from ordlab.operators import select as sel


def information(table):
    n = table.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        x = table / n * np.log(table * n / (table.sum(1, keepdims=True) * table.sum(0, keepdims=True)))
    return float(np.nansum(x))


def brute(counts, cells):
    """Every partition of one side into consecutive columns, equal-frequency rows on the other."""
    best = 0.0
    for t in (counts, counts.T):
        m = len(t)
        for rows in range(2, int(min(m, cells // 2)) + 1):
            y = np.stack([t[:, np.arange(m) * rows // m == r].sum(1) for r in range(rows)], 1)
            for columns in range(2, int(min(m, cells // rows)) + 1):
                for cuts in itertools.combinations(range(1, m), columns - 1):
                    e = [0, *cuts, m]
                    merged = np.array([y[a:b].sum(0) for a, b in zip(e, e[1:])])
                    best = max(best, information(merged) / math.log(min(rows, columns)))
    return best


def test_partition_search_equals_every_partition():
    rng = np.random.default_rng(0)
    for cells in (4, 9, 16):
        for _ in range(4):
            counts = rng.integers(0, 6, (6, 6)).astype(float)
            assert abs(sel.mic_of_counts(counts, cells) - brute(counts, cells)) < 1e-12
    diagonal = np.diag([5.0] * 8)
    assert abs(sel.mic_of_counts(diagonal, 16) - 1) < 1e-12


def plain(counts, cells):
    """The program over all grids, nothing left out."""
    n, best = counts.sum(), 0.0
    for t in (counts, counts.T):
        m, bins = t.shape
        for rows in range(2, int(min(bins, cells // 2)) + 1):
            y = np.stack([t[:, np.arange(bins) * rows // bins == r].sum(1) for r in range(rows)], 1)
            cum = np.vstack([np.zeros((1, rows)), y.cumsum(0)])
            part = np.maximum(cum[None] - cum[:, None], 0)
            gain = (part * np.log(np.maximum(part, 1))).sum(2) - part.sum(2) * np.log(np.maximum(part.sum(2), 1))
            gain[np.tril_indices(m + 1)] = -np.inf
            q = cum[-1][cum[-1] > 0] / n
            value = gain[0]
            for columns in range(2, int(min(m, cells // rows)) + 1):
                value = (value[:, None] + gain).max(0)
                best = max(best, (value[m] / n - (q * np.log(q)).sum()) / math.log(min(rows, columns)))
    return best


def test_bounds_leave_no_grid_out_that_counts():
    """small, uneven, empty, noisy and dependent tables; few and many rows."""
    rng = np.random.default_rng(8)
    for i in range(60):
        a, b = rng.integers(1, 14, 2) if i % 2 else [int(rng.integers(2, 44))] * 2
        counts = rng.poisson(rng.choice([0.3, 2.0, 20.0]), (a, b))
        if i % 3 == 0:
            counts += np.rint(30 * np.exp(-60 * (np.arange(a)[:, None] / a - np.arange(b)[None] / b) ** 2)).astype(int)
        cells = float(rng.choice([4, 7.5, 16, 33.3, 150, 500]))
        assert abs(sel.mic_of_counts(counts, cells) - (plain(counts, cells) if counts.any() else 0.0)) < 1e-12


def test_search_takes_all_bins(spark):
    """bins over 128 a side were merged, so what only finer bins show was lost."""
    n = 33_000
    df = spark.range(n).selectExpr("id", "cast(id as double) a", f"(id * 256 div {n}) % 2 + (id * 7919 % {n}) / {2 * n}d b")
    (got,) = sel.pair_mic_search(df, "id", ["a", "b"]).collect()
    (again,) = sel.pair_mic_search(df, "id", ["a", "b"], bins=sel.Bins(df, "id", ["a", "b"])).collect()
    assert got.mic > 0.99 and got == again


def test_search_takes_all_grids(spark):
    """the number of cells was rounded down to a power of two."""
    r = np.random.default_rng(3)
    n = 300
    v = r.normal(size=(n, 2))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "id long, a double, b double")
    at = v.argsort(0).argsort(0) * 8 // n
    counts = np.bincount(at[:, 0] * 8 + at[:, 1], minlength=64).reshape(8, 8)
    (got,) = sel.pair_mic_search(df, "id", ["a", "b"]).collect()
    assert abs(got.mic - brute(counts, n**0.6)) < 1e-12
    assert got.mic > brute(counts, 16) + 1e-3


def test_large_tables_of_counts_are_packed(spark, monkeypatch):
    """the counts of all bins of many pairs would not fit a task as 32-bit numbers."""
    r = np.random.default_rng(10)
    for top in (0, 1, 200, 70_000):
        counts = np.where(r.random(1 << 14) < 0.2, r.integers(0, top + 1, 1 << 14), 0)
        data = sel._packed(counts)
        assert (sel._unpacked(data, 1 << 14) == counts).all() and len(data) < 1.6 * (1 << 14)
    rows = [(i, *map(float, r.normal(size=4))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    whole = {(x.fa, x.fb): x.counts for x in sel.joint_counts(df, "id", list("abcd"), 500, 8, [(8, 8)]).collect()}
    at = (np.array([x[1:] for x in rows]).argsort(0).argsort(0) * 256) // 500
    assert len(whole) == 6 and all((sel._unpacked(x, 1 << 16) == np.bincount(at[:, i] * 256 + at[:, j], minlength=1 << 16)).all() for (i, j), x in whole.items())
    monkeypatch.setattr(sel, "BLOCK_BYTES", 1 << 20)  # blocks of two features
    assert {(x.fa, x.fb): x.counts for x in sel.joint_counts(df, "id", list("abcd"), 500, 8, [(8, 8)]).collect()} == whole


def test_never_below_the_dyadic_value(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    rows = [(i, float(x), float(x * x + 0.3 * rng.normal()), float(rng.normal()), float(np.sin(4 * x))) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    fine = {(r.feature_a, r.feature_b): r.mic for r in sel.pair_mic_search(df, "id", list("abcd")).collect()}
    coarse = {(r.feature_a, r.feature_b): r.mic for r in sel.pair_mic(df, "id", list("abcd")).collect()}
    assert set(fine) == set(coarse) and len(fine) == 6
    assert all(fine[k] >= coarse[k] - 1e-12 for k in fine)
    assert fine["a", "d"] > 0.45 and fine["a", "d"] > fine["a", "c"] + 0.15


def test_gradient_over_all_pairs(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(1, 5, 400), np.round(rng.normal(0, 1.2, 400), 2)
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))] + [(900, None, 1.0), (901, 2, None)]
    got = {r.id: r.grad for r in rk.pair_gradient(spark.createDataFrame(rows, "id long, y int, s double"), "id", "y", "s").collect()}
    hinge = np.maximum(1 - (s[:, None] - s[None, :]), 0) * (y[:, None] > y[None, :])
    want = -2 * hinge.sum(1) + 2 * hinge.sum(0)
    assert set(got) == set(range(400)) and np.allclose([got[i] for i in range(400)], want)
    assert rk.pair_gradient(spark.createDataFrame([], "id long, y int, s double"), "id", "y", "s").collect() == []


def test_fit_orders_the_classes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    rows = [(i, int(np.clip(np.round(4 + 2 * a - b + rng.normal(0, 0.3)), 1, 8)), float(a * 10 + 3), float(b)) for i, (a, b) in enumerate(x)]
    w = rk.pairwise_fit(spark.createDataFrame(rows, "id long, y int, a double, b double"), ["a", "b"], "y", "id", iters=5)
    score = np.array([w[0] * r[2] + w[1] * r[3] for r in rows])
    y = np.array([r[1] for r in rows])
    right = (score[:, None] > score[None, :])[y[:, None] > y[None, :]].mean()
    assert right > 0.93
