"""Bagged greedy selection against a plain restatement."""

import numpy as np

from pyspark.sql import functions as F

from ordlab.operators import bagging as bg


def decode(p, cdf):
    n, out = len(p), np.full(len(p), 8)
    rank = np.lexsort((np.arange(n), p))
    for k in range(6, -1, -1):
        out[rank[(int(n * cdf[k - 1]) if k else 0):max(int(n * cdf[k] - 1), 0)]] = k + 1
    return out


def kappa(a, b):
    return 1 - np.sum((a - b) ** 2) / (len(a) * (np.var(a) + np.var(b) + (a.mean() - b.mean()) ** 2))


def data(seed=3, n=160):
    rng = np.random.default_rng(seed)
    y = {r: rng.integers(1, 9, n) for r in (1, 2)}
    noise = {"a": 1.5, "b": 2.0, "c": 2.5, "d": 6.0}
    preds = {m: {r: y[r] + rng.normal(0, s, n) for r in y} for m, s in noise.items()}
    cdf = {r: [float(np.mean(y[r] <= k)) for k in range(1, 9)] for r in y}
    return y, preds, cdf


def plain(y, preds, cdf, bags, weights, top):
    def mean_kappa(p):
        return float(np.mean([kappa(y[r], decode(p[r], cdf[r])) for r in y]))

    ranked = sorted(preds, key=lambda m: (-mean_kappa(preds[m]), m))
    out = []
    for members in bg.draw_bags(ranked, bags):
        start = members[:top]
        blend = {r: np.mean([preds[m][r] for m in start], axis=0) for r in y}
        chosen, total, best = [(m, 1.0) for m in start], float(len(start)), mean_kappa(blend)
        while True:
            cand = [(-mean_kappa({r: (blend[r] + w * preds[m][r]) / (1 + w) for r in y}), m, w) for m in sorted(set(members)) for w in weights]
            k, m, w = min(cand)
            if -k <= best + 1e-9:
                break
            best, blend = -k, {r: (blend[r] + w * preds[m][r]) / (1 + w) for r in y}
            chosen.append((m, w * total))
            total *= 1 + w
        out.append((chosen, blend, best))
    return out


def test_selection_equals_the_plain_one(spark):
    y, preds, cdf = data()
    rows = [(m, r, i, float(v), int(y[r][i])) for m in preds for r in y for i, v in enumerate(preds[m][r])]
    df = spark.createDataFrame(rows, "model string, run int, id long, prediction double, target int").repartition(3)
    cd = spark.createDataFrame([(r, k + 1, f) for r in cdf for k, f in enumerate(cdf[r])], "run int, cls int, cdf double")
    sel = bg.bagged_selection(df, cd, bags=3, init_top_k=2, weights=(-0.3, 0.5, 1.0))
    want = plain(y, preds, cdf, 3, (-0.3, 0.5, 1.0), 2)
    for b, (chosen, blend, best) in enumerate(want):
        assert [m for m, _ in sel.chosen[b]] == [m for m, _ in chosen]
        assert np.allclose([w for _, w in sel.chosen[b]], [w for _, w in chosen]) and abs(sel.kappas[b][-1] - best) < 1e-9
    got = {(r.bag, r.run, r.id): r.blend for r in sel.blends.collect()}
    assert len(got) == 3 * 2 * 160 and all(abs(got[b, r, i] - want[b][1][r][i]) < 1e-9 for b, r, i in got)

    truth = df.select("run", "id", "target").distinct()
    progress, cuts = bg.bag_progress(sel, truth, cd)
    mean = {r: np.mean([w[1][r] for w in want], axis=0) for r in y}
    ks = [kappa(y[r], decode(mean[r], cdf[r])) for r in y]
    last = {r.bags: r for r in progress.collect()}[3]
    assert abs(last.kappa_mean - np.mean(ks)) < 1e-9 and abs(last.kappa_std - np.std(ks)) < 1e-9
    got_cut = {r.k: r.cut for r in cuts.filter("bags = 3").collect()}
    for k in range(1, 8):
        assert abs(got_cut[k] - np.mean([np.sort(mean[r])[int(160 * cdf[r][k - 1]) - 1] for r in y])) < 1e-9

    one = bg.apply_selection(sel.table(spark), df.filter("run = 1").select("id", "model", "prediction")).collect()
    assert all(abs(r.blend - mean[1][r.id]) < 1e-9 for r in one)


def test_bags_are_repeatable():
    names = [f"m{i}" for i in range(20)]
    a, b = bg.draw_bags(names, 4, 0.5), bg.draw_bags(names, 4, 0.5)
    assert a == b and len(a[0]) == 10 and a[0] != a[1]
    free = bg.draw_bags(names, 50, 0.3, replacement=False)
    assert all(len(set(x)) == len(x) for x in free) and 4 < np.mean([len(x) for x in free]) < 8
