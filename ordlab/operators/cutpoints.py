"""Cut-point fitting (X1, X2, M15): maximise QWK(label, cut-decode(score)).

``exact_cutpoints`` finds the best vector over all cut vectors of a grid; the
searches below it follow the reference's minimisers step by step.

A round evaluates a whole candidate table in one job without pairing rows
with candidates: the union of all candidate cut values forms a sorted grid
(bounded by candidates x 7), every row is bucketed into that grid with
``Bucketizer`` (JVM binary search), rows collapse to a ``(interval, label)``
histogram, and each candidate's class per interval follows from the grid
index of its cuts.  QWK is then a weighted-moment aggregate per candidate.
Only the winning cut vector (7 numbers) reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import c


def _grid(cands):
    return sorted({float(v) for cuts in cands for v in cuts})


def interval_hist(df: DataFrame, score: str, label: str, grid, by=None) -> DataFrame:
    """``(interval, y, cnt)``: interval = number of grid values strictly below the score."""
    from pyspark.ml.feature import Bucketizer
    by = list(by or [])
    g = len(grid)
    neg = [float("-inf")] + sorted(-v for v in grid) + [float("inf")]
    d = df.select(*by, (-c(score).cast("double")).alias("__ns"), c(label).cast("int").alias("y"))
    b = Bucketizer(splits=neg, inputCol="__ns", outputCol="__b", handleInvalid="keep").transform(d)
    # bucket j on -s counts grid values >= s, so #{grid < s} = G - j
    return (b.groupBy(*by, (F.lit(g) - F.col("__b").cast("int")).alias("interval"), "y")
             .agg(F.count(F.lit(1)).alias("cnt")))


def score_candidates(df: DataFrame, score: str, label: str, cands, by=None) -> DataFrame:
    """M15 for a candidate table: ``(cand, kappa)`` (``by`` adds grouping, e.g. runs).

    ``cands`` is a list of cut vectors; their index in the list is ``cand``."""
    by = list(by or [])
    grid = _grid(cands)
    pos = {v: i for i, v in enumerate(grid)}
    hist = interval_hist(df, score, label, grid, by)
    spark = df.sparkSession
    # candidate x interval -> class: a parameter-sized table (cands x (grid+1))
    rows = []
    for ci, cuts in enumerate(cands):
        ix = sorted(pos[float(v)] for v in cuts)
        for i in range(len(grid) + 1):
            rows.append((ci, i, 1 + sum(1 for j in ix if j < i)))
    cls = spark.createDataFrame(rows, "cand int, interval int, cls int")
    j = hist.join(F.broadcast(cls), "interval")
    y, k, n = F.col("y").cast("double"), F.col("cls").cast("double"), F.col("cnt").cast("double")
    g = j.groupBy(*by, "cand").agg(
        F.sum(n).alias("n"), F.sum(n * (y - k) * (y - k)).alias("o"),
        F.sum(n * y).alias("sa"), F.sum(n * y * y).alias("saa"),
        F.sum(n * k).alias("sb"), F.sum(n * k * k).alias("sbb"))
    e = F.col("saa") + F.col("sbb") - F.lit(2.0) * F.col("sa") * F.col("sb") / F.col("n")
    return g.select(*by, "cand", (F.lit(1.0) - F.col("o") / F.nullif(e, F.lit(0.0))).alias("kappa"))


def _best(scores: DataFrame, cands):
    r = scores.orderBy(F.desc_nulls_last("kappa"), "cand").first()
    return list(cands[r["cand"]]), (float(r["kappa"]) if r["kappa"] is not None else float("-inf"))


def fit_cutpoints(df: DataFrame, score: str, label: str, start, step: float = 0.5,
                  min_step: float = 0.01):
    """Coordinate search from ``start``; each round scores the current
    vector and every single-cut move of +-step in one job, keeps the best,
    and halves the step when nothing improves.  Returns ``(cuts, kappa)``."""
    from ordlab.session import materialize
    base = materialize(df.select(c(score).alias("s"), c(label).alias("y")), "cuts")
    cur = sorted(float(v) for v in start)
    best_k = None
    while True:  # each pass improves the kappa or halves the step
        cands = [cur]
        for i in range(len(cur)):
            for d in (-step, step):
                v = list(cur)
                v[i] = round(v[i] + d, 10)
                cands.append(sorted(v))
        cuts, k = _best(score_candidates(base, "s", "y", cands), cands)
        if best_k is None or k > best_k + 1e-12:
            improved = best_k is not None and cuts != cur
            cur, best_k = cuts, k
            if improved:
                continue
        if step <= min_step:
            break
        step /= 2.0
    return cur, best_k


def random_search_cutpoints(df: DataFrame, score: str, label: str, n_candidates: int = 64,
                            generations: int = 5, lo: float = 0.0, hi: float = 9.0, seed: int = 0,
                            n_cuts: int = 7):
    """Seeded random population search in ``[lo, hi]``; every generation is
    one job over the candidate table, the best survives into the next."""
    from ordlab.session import materialize
    base = materialize(df.select(c(score).alias("s"), c(label).alias("y")), "cuts")
    rng = np.random.default_rng(seed)
    best, best_k = None, float("-inf")
    for _ in range(generations):
        cands = [sorted(np.round(rng.uniform(lo, hi, n_cuts), 6).tolist()) for _ in range(n_candidates)]
        if best is not None:
            cands[0] = best
        cuts, k = _best(score_candidates(base, "s", "y", cands), cands)
        if k > best_k:
            best, best_k = cuts, k
    return best, best_k


def best_cuts(counts: np.ndarray, labels: np.ndarray, n_classes: int) -> tuple[list[int], float | None]:
    """The cut vector of greatest QWK over a histogram ``counts[bin, label]``:
    ``cut[k]`` is the first bin of class k+2 or above (0: no bin lies below it;
    the last bin always has the highest class that is left open).

    With the label histogram fixed, both the observed disagreement O and the
    expected one E are sums over the bins, so O - l E is minimised exactly by a
    program over (bin, class): f_k(i) = S_k(i) + min_{j <= i} (f_{k-1}(j) - S_k(j)), with
    S_k the running cost of class k.  Dinkelbach's iteration l <- O / E ends at the
    least ratio.  Of equal vectors the one with the lower cuts is returned."""
    k = np.arange(1, n_classes + 1, dtype=np.float64)
    n, per_bin, per_label = counts.sum(), counts.sum(1), counts.sum(0)
    apart = (labels[:, None] - k[None, :]) ** 2
    o, e = counts @ apart, per_bin[:, None] * (per_label @ apart / n)[None, :]
    so, se = (np.vstack([np.zeros(n_classes), np.cumsum(x, 0)]) for x in (o, e))
    ratio, cuts, last = 1.0, None, len(counts) - 1
    while True:
        s = so - ratio * se
        f, came = s[:-1, 0], []
        for j in range(1, n_classes):
            x = f - s[:-1, j]
            least = np.minimum.accumulate(x)
            new = np.concatenate(([True], x[1:] < least[:-1]))
            came.append(np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)))
            f = s[:-1, j] + least
        at, now = last, []
        for c_ in reversed(came):
            at = int(c_[at])
            now.append(at)
        now = now[::-1]
        edges = [0, *now, len(counts)]
        got_o = sum(so[b, j] - so[a, j] for j, (a, b) in enumerate(zip(edges, edges[1:])))
        got_e = sum(se[b, j] - se[a, j] for j, (a, b) in enumerate(zip(edges, edges[1:])))
        if got_e <= 0:
            return now, None  # one label, one class
        if cuts is not None and got_o / got_e >= ratio:
            return cuts, 1.0 - ratio
        ratio, cuts = got_o / got_e, now


def _grid_of(d: DataFrame, max_bins: int) -> tuple[list[float], bool]:
    """All distinct scores if there are at most ``max_bins``, else as many
    quantiles (the greatest score among them), and whether these are all."""
    few = [r[0] for r in d.select("s").distinct().limit(max_bins + 1).collect()]
    if len(few) <= max_bins:
        return sorted(few), True
    q = d.agg(F.percentile_approx("s", [(i + 1) / max_bins for i in range(max_bins)], max_bins * 4)).first()[0]
    return sorted({float(v) for v in q}), False


def _cuts_on_grid(d: DataFrame, grid, n_classes: int, by) -> DataFrame:
    """``by + [k, cut, at, kappa]``: the best cuts out of the grid (or below all of it), per group."""
    hist = interval_hist(d, "s", "y", grid, by)
    values = np.array([grid[0] - 1.0, *grid])
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def fit(part):
        labels, y = np.unique(part["y"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(grid) + 1, len(labels)))
        counts[part["interval"].to_numpy(), y] = part["cnt"].to_numpy()
        cuts, kappa = best_cuts(counts, labels.astype(np.float64), n_classes)
        out = {b: [part[b].iloc[0]] * len(cuts) for b in by}
        return pd.DataFrame(out | {"k": range(1, len(cuts) + 1), "cut": values[cuts], "at": cuts, "kappa": [kappa] * len(cuts)})

    # a group has one row per (grid interval, label): bounded by the grid
    schema = ", ".join([f"`{b}` {kinds[b]}" for b in by] + ["k int, cut double, at int, kappa double"])
    return (hist.groupBy(*by) if by else hist.withColumn("__one", F.lit(0)).groupBy("__one")).applyInPandas(fit, schema)


def exact_cutpoints(df: DataFrame, score: str, label: str, n_classes: int = 8, by=None, grid=None,
                    max_bins: int = 20_000) -> DataFrame:
    """The cut vector of greatest QWK, as ``by + [k, cut, kappa]``.

    Exact over every cut vector whose cuts stand in ``grid`` or below it.  Without a
    grid all distinct scores are the grid, which makes the result the best of all
    vectors of real numbers; a table with more than ``max_bins`` of them starts
    from that many quantiles and then opens the intervals next to the chosen cuts
    until the kappa stops rising (it never falls, as the chosen cuts stay in the
    grid).  Rows without a label or a score count for nothing.  Only the grid
    (bounded by ``max_bins``) is on the driver."""
    from ordlab.session import materialize
    by = list(by or [])
    d = df.select(*by, c(score).cast("double").alias("s"), c(label).cast("int").alias("y"))
    d = materialize(d.filter(F.col("s").isNotNull() & ~F.isnan("s") & F.col("y").isNotNull()), "cuts")
    if grid is not None:
        return _cuts_on_grid(d, sorted({float(v) for v in grid}), n_classes, by).drop("at")
    grid, whole = _grid_of(d, max_bins)
    if not grid:
        return _cuts_on_grid(d, [0.0], n_classes, by).drop("at")
    best = materialize(_cuts_on_grid(d, grid, n_classes, by), "cuts")
    while not whole:
        near = sorted({j for (a,) in best.select("at").distinct().collect() for j in (a - 1, a, a + 1) if 0 <= j <= len(grid)})
        keep = sorted({float(r[0]) for r in best.select("cut").distinct().collect()} | {grid[-1]})
        spans = [((grid[j - 1] if j else float("-inf")), grid[j] if j < len(grid) else float("inf")) for j in near]
        share = max(max_bins // max(len(spans), 1), 2)
        probs = [(i + 1) / share for i in range(share)]
        opened = d.agg(*[F.percentile_approx(F.when((F.col("s") > a) & (F.col("s") <= b), F.col("s")), probs, share * 4) for a, b in spans]).first()
        finer = sorted(set(keep) | {float(v) for q in opened if q for v in q})
        new = materialize(_cuts_on_grid(d, finer, n_classes, by), "cuts")
        gain = new.agg(F.sum("kappa")).first()[0] or 0.0
        if gain <= (best.agg(F.sum("kappa")).first()[0] or 0.0) + 1e-12:
            break
        grid, best = finer, new
    return best.drop("at")
