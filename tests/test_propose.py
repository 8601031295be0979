"""Parzen proposer: densities restated in plain loops, replay, and its gain over a grid."""

import itertools
import math

import numpy as np

from ordlab.operators import propose as pr

SPACE = {"a": ("uniform", 0.0, 1.0), "b": ("loguniform", 1e-3, 1.0), "k": ("quniform", 1, 9, 1), "c": ("choice", ["x", "y", "z"])}


def plain_density(x, points, lo, hi):
    """Mean of the cut-off normal kernels, kernel by kernel."""
    centre = sorted([*points, (lo + hi) / 2])
    mid = centre.index((lo + hi) / 2)
    total = 0.0
    for i, m in enumerate(centre):
        left = m - centre[i - 1] if i else 0.0
        right = centre[i + 1] - m if i + 1 < len(centre) else 0.0
        s = hi - lo if i == mid or len(centre) == 1 else max(left, right)
        s = min(max(s, (hi - lo) / min(100, len(centre) + 1)), hi - lo)
        cdf = lambda v: 0.5 * (1 + math.erf((v - m) / s / math.sqrt(2)))  # noqa: B023, E731
        total += math.exp(-0.5 * ((x - m) / s) ** 2) / s / math.sqrt(2 * math.pi) / (cdf(hi) - cdf(lo))
    return total / len(centre)


def test_density_equals_plain_loops_and_sums_to_one():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 40):
        points = rng.uniform(2, 5, n)
        x = np.linspace(2, 5, 3001)
        d = pr.density(x, points, 2.0, 5.0)
        assert np.allclose(d[::200], [plain_density(v, points.tolist(), 2.0, 5.0) for v in x[::200]])
        assert abs(np.trapezoid(d, x) - 1) < 1e-3


def peak(s):
    return (math.exp(-8 * (s["a"] - 0.83) ** 2) * math.exp(-(math.log(s["b"]) - math.log(0.02)) ** 2 / 4)
            * (1 - abs(s["k"] - 7) / 12) * {"x": 0.8, "y": 1.0, "z": 0.7}[s["c"]], 0.0)


def test_proposals_choose_by_ratio_and_replay():
    log = pr.search(lambda b: [peak(s) for s in b], SPACE, trials=30, batch=3, seed=5)
    assert len(log) == 30 and [t["trial"] for t in log] == list(range(30))
    assert all(0 <= t["a"] <= 1 and 1e-3 <= t["b"] <= 1 and t["k"] in range(1, 10) and t["c"] in "xyz" for t in log)
    assert pr.search(lambda b: [peak(s) for s in b], SPACE, trials=30, batch=3, seed=5) == log
    assert pr.search(lambda b: [peak(s) for s in b], SPACE, trials=30, batch=3, seed=5, log=log[:12]) == log  # resumed
    # the same draws, scored in plain loops
    good, bad = pr.split_log(log)
    assert len(good) == 8 and min(t["kappa_mean"] for t in good) >= max(t["kappa_mean"] for t in bad)
    space = {"a": SPACE["a"]}
    rng = np.random.default_rng([9, 30])
    x = pr._draw(rng, np.array([t["a"] for t in good]), 0.0, 1.0, 24)
    ratio = [math.log(plain_density(v, [t["a"] for t in good], 0, 1)) - math.log(plain_density(v, [t["a"] for t in bad], 0, 1)) for v in x]
    want = [float(x[i]) for i in sorted(range(24), key=lambda i: -ratio[i])[:4]]
    assert [p["a"] for p in pr.propose(log, space, 4, seed=9)] == want


def test_beats_the_grid_at_equal_trials():
    grid = [dict(zip(SPACE, v)) for v in itertools.product([0.0, 0.5, 1.0], [1e-3, 3e-2, 1.0], [1, 5, 9], "xyz")]
    best_grid = max(peak(s)[0] for s in grid)
    best = [max(t["kappa_mean"] for t in pr.search(lambda b: [peak(s) for s in b], SPACE, trials=len(grid), batch=3, seed=s)) for s in range(8)]
    assert np.mean(best) > best_grid + 0.05 and min(best) > best_grid


def test_a_trial_without_a_value_is_bad():
    log = [{"a": i / 10, "kappa_mean": float("nan") if i % 2 else i / 10} for i in range(10)]
    good, bad = pr.split_log(log)
    assert [t["a"] for t in good] == [0.8, 0.6, 0.4] and len(bad) == 7
