"""Parzen proposer for parameter search.

The trial log is split at a quantile of the kappa into good and bad trials.  Per
parameter a Parzen density of each part (normal kernels at the trials' values and
one wide kernel over the whole range, all cut off at the bounds) gives draws from
the good one; the draws of greatest summed log ratio good / bad are proposed,
a batch at a time, so that a batch is fitted in parallel.  A proposal depends on
the log, the seed and the number of trials only, so a search can be resumed from
its log and replayed.

The log has a row per trial; the fits are Spark jobs.

A space maps a name to ``("uniform", lo, hi)``, ``("quniform", lo, hi, step)``,
``("loguniform", lo, hi)`` (bounds of the value, searched on its logarithm) or
``("choice", [values])``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import TypeConverters
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame

from ordlab.operators.split import kfold

GAMMA, DRAWS, START = 0.25, 24, 8


def _bounds(spec) -> tuple[float, float]:
    kind = spec[0]
    lo, hi = (math.log(spec[1]), math.log(spec[2])) if kind == "loguniform" else (float(spec[1]), float(spec[2]))
    return (lo - spec[3] / 2, hi + spec[3] / 2) if kind == "quniform" else (lo, hi)


def _inner(spec, value) -> float:
    return math.log(value) if spec[0] == "loguniform" else float(value)


def _outer(spec, x: float) -> float:
    if spec[0] == "loguniform":
        return float(min(max(math.exp(x), spec[1]), spec[2]))
    if spec[0] == "quniform":
        steps = round((x - spec[1]) / spec[3])
        return float(min(max(spec[1] + steps * spec[3], spec[1]), spec[2]))
    return float(x)


def kernels(points: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths: the points with the distance to their farther
    neighbour (at least range / min(100, n + 2)), and one kernel over the range."""
    span = hi - lo
    centre = np.sort(np.append(points, (lo + hi) / 2))
    width = np.full(len(centre), span)
    if len(centre) > 1:
        gap = np.diff(centre)
        width = np.maximum(np.append(gap, 0.0), np.insert(gap, 0, 0.0))
    width = np.clip(width, span / min(100.0, len(centre) + 1.0), span)
    width[np.searchsorted(centre, (lo + hi) / 2)] = span
    return centre, width


def _phi(z):
    return 0.5 * (1.0 + np.vectorize(math.erf)(z / math.sqrt(2.0)))


def density(x: np.ndarray, points: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Parzen density at ``x``: equal weights, each kernel cut off at the bounds."""
    centre, width = kernels(points, lo, hi)
    inside = _phi((hi - centre) / width) - _phi((lo - centre) / width)
    z = (x[:, None] - centre) / width
    return (np.exp(-0.5 * z * z) / (width * math.sqrt(2.0 * math.pi) * inside)).mean(1)


def _draw(rng, points: np.ndarray, lo: float, hi: float, n: int) -> np.ndarray:
    centre, width = kernels(points, lo, hi)
    which = rng.integers(len(centre), size=n)
    out = rng.normal(centre[which], width[which])
    for _ in range(64):
        bad = (out < lo) | (out > hi)
        if not bad.any():
            break
        out[bad] = rng.normal(centre[which[bad]], width[which[bad]])
    return np.clip(out, lo, hi)


def split_log(log: list[dict], gamma: float = GAMMA) -> tuple[list[dict], list[dict]]:
    """Good trials (the best ``ceil(gamma n)``, earlier ones first on ties) and the others.
    A trial whose kappa has no value is bad."""
    order = sorted(range(len(log)), key=lambda i: (-(log[i]["kappa_mean"] if log[i]["kappa_mean"] == log[i]["kappa_mean"] else -math.inf), i))
    n = math.ceil(gamma * len(log))
    return [log[i] for i in order[:n]], [log[i] for i in order[n:]]


def propose(log: list[dict], space: dict, batch: int, seed: int = 1, start: int = START, draws: int = DRAWS, gamma: float = GAMMA) -> list[dict]:
    """The next ``batch`` settings after the trials of ``log`` (dicts of the
    parameters and ``kappa_mean``).  The first ``start`` trials are uniform draws."""
    rng = np.random.default_rng([seed, len(log)])
    out = []
    if len(log) < start:
        for _ in range(batch):
            out.append({name: spec[1][int(rng.integers(len(spec[1])))] if spec[0] == "choice" else _outer(spec, rng.uniform(*_bounds(spec)))
                        for name, spec in space.items()})
        return out
    good, bad = split_log(log, gamma)
    n = max(draws, batch * 4)
    score, values = np.zeros(n), {}
    for name, spec in space.items():
        if spec[0] == "choice":
            count = [np.array([sum(t[name] == v for t in part) for v in spec[1]], float) + 1.0 for part in (good, bad)]
            share = [k / k.sum() for k in count]
            pick = rng.choice(len(spec[1]), size=n, p=share[0])
            values[name] = [spec[1][i] for i in pick]
            score += np.log(share[0][pick]) - np.log(share[1][pick])
        else:
            lo, hi = _bounds(spec)
            g, b = (np.array([_inner(spec, t[name]) for t in part]) for part in (good, bad))
            x = _draw(rng, g, lo, hi, n)
            values[name] = [_outer(spec, v) for v in x]
            score += np.log(density(x, g, lo, hi)) - np.log(density(x, b, lo, hi))
    for i in np.argsort(-score, kind="stable"):
        setting = {name: v[i] for name, v in values.items()}
        if setting not in out:
            out.append(setting)
        if len(out) == batch:
            break
    return out


def search(evaluate: Callable[[list[dict]], list[tuple[float, float]]], space: dict, trials: int, batch: int = 4, seed: int = 1,
           log: list[dict] | None = None, **options) -> list[dict]:
    """Trials until the log has ``trials`` of them.  ``evaluate`` maps settings to
    ``(kappa_mean, kappa_std)``; ``log`` holds earlier trials of the same search."""
    log = list(log or [])
    while len(log) < trials:
        batch_now = propose(log, space, min(batch, trials - len(log)), seed, **options)
        for setting, (mean, std) in zip(batch_now, evaluate(batch_now)):
            log.append({"trial": len(log), **setting, "kappa_mean": float(mean), "kappa_std": float(std)})
    return log


def cv_evaluator(df: DataFrame, features, id_col: str, estimator, evaluator, folds: int = 3, parallelism: int = 4) -> Callable:
    """``evaluate`` for ``search``: each setting of the estimator's parameters is
    cross-validated on hash folds; the settings of a batch are fitted side by side."""
    d = kfold(df, id_col, folds, "fold")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), estimator])

    def evaluate(settings: list[dict]) -> list[tuple[float, float]]:
        maps = [{p: int(round(v)) if p.typeConverter is TypeConverters.toInt else v
                 for p, v in ((estimator.getParam(k), v) for k, v in s.items())} for s in settings]
        m = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=evaluator, foldCol="fold", parallelism=parallelism).fit(d)
        return list(zip(m.avgMetrics, m.stdMetrics))

    return evaluate
