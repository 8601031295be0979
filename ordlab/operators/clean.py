"""Cleaning and imputation.

Fill values are aggregates: one row per split joined back on the split key,
or one row attached as a scalar subquery, so a fill is one scan for the
statistic plus one projection; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import c
from ordlab.operators.frame import attach, match
from ordlab.operators.orderstats import medians
from ordlab.session import fitted


def fill_sentinel(df: DataFrame, cols, value=-1) -> DataFrame:
    """Fill the listed columns with a literal."""
    return df.na.fill(value, list(cols))


def _stat_fill(df: DataFrame, cols, stats, by=None, suffix: str = "") -> DataFrame:
    """``stats(df, cols, by)`` gives a row of fill values per group."""
    by = list(by or [])
    st = stats(df, list(cols), by).withColumnsRenamed({x: f"__f_{x}" for x in cols})
    j = match(df, fitted(st, "fill"), by) if by else attach(df, st)
    j = j.withColumns({f"{x}{suffix}": F.coalesce(F.col(x).cast("double"), F.col(f"__f_{x}")) for x in cols})
    return j.drop(*[f"__f_{x}" for x in cols])


def fill_mean(df: DataFrame, cols, by=None, suffix: str = "") -> DataFrame:
    """Null-skipping mean fill; ``by=['split']`` gives train and test
    each their own mean (C2), no ``by`` the whole-table imputer (C4)."""
    def means(d, names, keys):
        return d.groupBy(*keys).agg(*[F.avg(F.col(x).cast("double")).alias(x) for x in names])

    return _stat_fill(df, cols, means, by, suffix)


def fill_median(df: DataFrame, cols, by=None, suffix: str = "") -> DataFrame:
    """Exact median of the non-null values (Q10), by refined histograms."""
    return _stat_fill(df, cols, medians, by, suffix)


def fill_mean_or_value(df: DataFrame, cols, strategy="mean", by=None) -> DataFrame:
    """``strategy='mean'`` or a literal fill value."""
    if strategy == "mean":
        return fill_mean(df, cols, by)
    return df.na.fill(strategy, list(cols))


def fill_unknown_code(df: DataFrame, col: str, code: str = "Z0") -> DataFrame:
    """Unknown code -> ``'Z0'`` before the code is split."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(code)))


def ridge_single_fit(df: DataFrame, x: str, y: str, alpha: float, by=None) -> DataFrame:
    """Closed-form ridge with one predictor on a normalised design (C6):
    ``slope = Sxy / (Sxx (1 + alpha))``, ``intercept = avg(y) - slope avg(x)``;
    fitted on rows where both are non-null, per ``by`` group."""
    by = list(by or [])
    d = df.filter(c(x).isNotNull() & c(y).isNotNull())
    xx, yy = c(x).cast("double"), c(y).cast("double")
    g = d.groupBy(*by).agg(F.regr_sxy(yy, xx).alias("__sxy"), F.regr_sxx(yy, xx).alias("__sxx"),
                           F.avg(xx).alias("__mx"), F.avg(yy).alias("__my"))
    slope = F.col("__sxy") / F.nullif(F.col("__sxx") * F.lit(1.0 + alpha), F.lit(0.0))
    return g.select(*by, slope.alias("slope"),
                    (F.col("__my") - slope * F.col("__mx")).alias("intercept"))


def impute_ridge_single(df: DataFrame, x: str, y: str, alpha: float, by=None,
                        categorical: bool = True, out: str | None = None) -> DataFrame:
    """C6 with one predictor: fill null ``y`` from the per-group ridge line;
    categorical targets get ``rint`` of the prediction (Q4)."""
    by = list(by or [])
    out = out or f"{y}_filled"
    fit = ridge_single_fit(df, x, y, alpha, by)
    if by:
        fit = fitted(fit, "ridge")
        j = match(df, fit, by)
    else:
        j = attach(df, fit)
    pred = F.col("intercept") + F.col("slope") * c(x).cast("double")
    if categorical:
        pred = F.rint(pred)
    return j.withColumn(out, F.coalesce(c(y).cast("double"), pred)).drop("slope", "intercept")


def ridge_multi_fit(df: DataFrame, features, target: str, alpha: float, by=None) -> DataFrame:
    """C6 with many predictors: ridge on the normalised design, fitted for all
    groups in one aggregate of the complete rows' covariances; each group's
    normal equations (one row) are then solved inside a task.  Returns
    ``by, __coef, __intercept``; a predictor that does not vary gets 0."""
    import numpy as np
    features, by = list(features), list(by or [])
    cols = [c(f).cast("double") for f in features] + [c(target).cast("double")]
    full = df
    for x in cols:
        full = full.filter(x.isNotNull())
    d = len(features)
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    g = full.groupBy(*by).agg(F.array(*[F.avg(x) for x in cols]).alias("__m"),
                              F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("__c"))

    def solve(frames):
        for pdf in frames:
            coef, intercept = [], []
            for m, flat in zip(pdf["__m"], pdf["__c"]):
                cov = np.zeros((d + 1, d + 1))
                for (i, j), v in zip(pairs, flat):
                    cov[i, j] = cov[j, i] = v
                sd = np.sqrt(np.diag(cov)[:d])
                use = sd > 0
                w = np.zeros(d)
                corr = cov[:d, :d][np.ix_(use, use)] / np.outer(sd[use], sd[use])
                w[use] = np.linalg.solve(corr + alpha * np.eye(use.sum()), cov[:d, d][use] / sd[use]) / sd[use]
                coef.append(w.tolist())
                intercept.append(float(m[d] - w @ np.asarray(m[:d], float)))
            out = pdf[by].copy()
            out["__coef"], out["__intercept"] = coef, intercept
            yield out

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema]
                       + ["__coef array<double>", "__intercept double"])
    return g.mapInPandas(solve, fields)


def impute_ridge_multi(df: DataFrame, features, target: str, alpha: float, by: str | None = None,
                       categorical: bool = False, out: str | None = None) -> DataFrame:
    """C6 with many predictors: null targets get the prediction of
    ``ridge_multi_fit`` (``rint`` of it for categorical targets), fitted per
    value of ``by`` (train and test separately, as the reference), of which
    there may be any number."""
    out, by = out or f"{target}_filled", [by] if by else []
    fit = fitted(ridge_multi_fit(df, features, target, alpha, by), "ridge-multi")
    j = match(df, fit, by) if by else attach(df, fit)
    p = F.col("__intercept")
    for i, f in enumerate(features):
        p = p + F.col("__coef")[i] * c(f).cast("double")
    if categorical:
        p = F.rint(p)
    return j.withColumn(out, F.coalesce(c(target).cast("double"), p)).drop("__coef", "__intercept")
