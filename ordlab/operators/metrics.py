"""Agreement and error metrics (M1-M13), all as grouped aggregates.

Every metric takes ``by`` (a list of grouping columns, e.g. ``["run"]``) and
returns one row per group.  The kappa family never materialises the dense
rating matrix: quadratic kappa is a closed form of five moments (one partial
aggregate, no shuffle beyond the group keys); linear and unweighted kappa work
on the two rating histograms, which have one row per (group, rating).

Range convention (Q2): the rating range is min..max over both raters; the
(K-1) weight normaliser cancels in every ratio, and a single-rating range
gives a 0/0 ratio, returned as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordlab.functions.scalar import c, clamp, safe_div


def _by(by):
    return list(by or [])


def _rated(a: str, b: str) -> tuple:
    """The two ratings, null unless both raters rated the row: agreement is
    defined on such rows only, and a group without any has no row in the result.
    This is an expression and no filter, because a filter on a decoded class
    would be moved below the decoder and copy it into every condition."""
    both = c(a).isNotNull() & c(b).isNotNull()
    return F.when(both, c(a)), F.when(both, c(b))


def _keyed(df: DataFrame, by):
    """Grouping keys; an ungrouped metric groups on a constant key so that
    its partial results still combine by equi-join, never by a cross join."""
    by = _by(by)
    if by:
        return df, by, by
    return df.withColumn("__g", F.lit(0)), ["__g"], []


def _combine(o: DataFrame, e: DataFrame, by, keep) -> DataFrame:
    """Join two per-group partial results; ungrouped ones (one row each) are
    combined through a scalar subquery instead of a constant-key join."""
    if keep:
        return o.join(e, by)
    from ordlab.operators.frame import attach
    return attach(o.drop(*by), e.drop(*by))


def qwk(df: DataFrame, a: str, b: str, by=None, out: str = "kappa") -> DataFrame:
    """M3: quadratic weighted kappa per group.

    ``1 - sum((a-b)^2) / (n * (var_pop(a) + var_pop(b) + (avg(a)-avg(b))^2))`` —
    algebraically the dense-matrix definition, computed in one pass.
    """
    by = _by(by)
    a_, b_ = (x.cast("double") for x in _rated(a, b))
    g = df.groupBy(*by).agg(
        F.count(a_).alias("__n"),
        F.sum((a_ - b_) * (a_ - b_)).alias("__o"),
        F.var_pop(a_).alias("__va"), F.var_pop(b_).alias("__vb"),
        F.avg(a_).alias("__ma"), F.avg(b_).alias("__mb"))
    e = F.col("__n") * (F.col("__va") + F.col("__vb") + (F.col("__ma") - F.col("__mb")) ** 2)
    return (g.filter("__n > 0") if by else g).select(*by, (F.lit(1.0) - safe_div("__o", e)).alias(out))


def _hist_pair(df: DataFrame, a: str, b: str, by):
    """Counts of both raters' ratings; rows that only one rated count as 0 under a null rating."""
    a_, b_ = _rated(a, b)
    ha = df.groupBy(*by, a_.alias("v")).agg(F.count(a_).alias("ca"))
    hb = df.groupBy(*by, b_.alias("v")).agg(F.count(b_).alias("cb"))
    return (ha.join(hb, by + ["v"], "full")
              .na.fill(0, ["ca", "cb"]))


def linear_kappa(df: DataFrame, a: str, b: str, by=None, out: str = "kappa") -> DataFrame:
    """M4: linear weighted kappa, ``d = |i-j|``.

    The expected term ``sum_ij ha_i hb_j |i-j|`` is computed from running sums
    of the b-histogram in rating order (no rating x rating pairs)."""
    df, by, keep = _keyed(df, by)
    h = _hist_pair(df, a, b, by)
    word = Window.partitionBy(*by).orderBy("v")
    below = word.rowsBetween(Window.unboundedPreceding, -1)
    above = word.rowsBetween(1, Window.unboundedFollowing)
    v = F.col("v").cast("double")
    h = h.select(
        *by, "v", "ca", "cb",
        F.coalesce(F.sum("cb").over(below), F.lit(0)).alias("cb_lo"),
        F.coalesce(F.sum(F.col("cb") * v).over(below), F.lit(0.0)).alias("sb_lo"),
        F.coalesce(F.sum("cb").over(above), F.lit(0)).alias("cb_hi"),
        F.coalesce(F.sum(F.col("cb") * v).over(above), F.lit(0.0)).alias("sb_hi"))
    exp_part = F.col("ca") * (v * F.col("cb_lo") - F.col("sb_lo") + F.col("sb_hi") - v * F.col("cb_hi"))
    e = h.groupBy(*by).agg(F.sum(exp_part).alias("__e"), F.sum("ca").alias("__n"))
    o = df.groupBy(*by).agg(F.sum(F.abs(c(a) - c(b)).cast("double")).alias("__o"))
    both = _combine(o, e, by, keep)
    return (both.filter("__n > 0") if keep else both).select(*keep, (F.lit(1.0) - safe_div("__o", F.col("__e") / F.col("__n")))
                                           .alias(out))


def cohen_kappa(df: DataFrame, a: str, b: str, by=None, out: str = "kappa") -> DataFrame:
    """M5: unweighted kappa; expected disagreement ``n - sum_v ha_v hb_v / n``."""
    df, by, keep = _keyed(df, by)
    h = _hist_pair(df, a, b, by)
    e = h.groupBy(*by).agg(F.sum(F.col("ca") * F.col("cb")).alias("__m"), F.sum("ca").alias("__n"))
    o = df.groupBy(*by).agg(F.sum(F.when(c(a) != c(b), 1.0).otherwise(0.0)).alias("__o"))
    exp_ = F.col("__n") - F.col("__m") / F.col("__n")
    both = _combine(o, e, by, keep)
    return (both.filter("__n > 0") if keep else both).select(*keep, (F.lit(1.0) - safe_div("__o", exp_)).alias(out))


def mean_kappa_z(df: DataFrame, kappa: str, weight: str | None = None, by=None,
                 out: str = "mean_kappa") -> DataFrame:
    """M6: Fisher-z mean of kappas, weights scaled to mean 1, clamp to +-0.999."""
    by = _by(by)
    k = clamp(kappa, -0.999, 0.999)
    z = F.lit(0.5) * F.ln((F.lit(1.0) + k) / (F.lit(1.0) - k))
    if weight:
        if by:
            wn = c(weight) / F.avg(c(weight)).over(Window.partitionBy(*by))
        else:
            wn = c(weight) / df.agg(F.avg(c(weight))).scalar()
        z = z * wn
    zz = df.select(*by, z.alias("__z")).groupBy(*by).agg(F.avg("__z").alias("__z"))
    return zz.select(*by, F.tanh("__z").alias(out))


def confusion(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Dense confusion counts over the rating range min..max of both
    raters (zero cells included).  The grid is generated from the range, its
    size is the squared rating range, not the row count."""
    by = _by(by)
    rng = df.groupBy(*by).agg(F.least(F.min(a), F.min(b)).alias("__lo"),
                              F.greatest(F.max(a), F.max(b)).alias("__hi"))
    grid = (rng.select(*by, F.explode(F.sequence("__lo", "__hi")).alias("a"), "__lo", "__hi")
               .select(*by, "a", F.explode(F.sequence("__lo", "__hi")).alias("b")))
    cnt = df.groupBy(*by, c(a).alias("a"), c(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return (grid.join(cnt, by + ["a", "b"], "left")
                .select(*by, "a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def rating_hist(df: DataFrame, col: str, by=None, lo=None, hi=None) -> DataFrame:
    """Zero-filled histogram over ``lo..hi`` (default: observed range)."""
    by = _by(by)
    rng = df.groupBy(*by).agg(
        (F.lit(lo) if lo is not None else F.min(col)).alias("__lo"),
        (F.lit(hi) if hi is not None else F.max(col)).alias("__hi"))
    grid = rng.select(*by, F.explode(F.sequence(F.col("__lo").cast("int"), F.col("__hi").cast("int")))
                      .alias("rating"))
    cnt = df.groupBy(*by, c(col).cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    return (grid.join(cnt, by + ["rating"], "left")
                .select(*by, "rating", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def error_pairs(df: DataFrame, raw: str, pred: str) -> DataFrame:
    """Counts of ``"raw:pred"`` keys over mismatching rows."""
    return (df.filter(c(raw) != c(pred))
              .groupBy(F.concat_ws(":", c(raw).cast("string"), c(pred).cast("string")).alias("key"))
              .agg(F.count(F.lit(1)).alias("value")))


def accuracy(df: DataFrame, a: str, b: str, by=None, out: str = "accuracy") -> DataFrame:
    """M8: share of rows where the truncated values agree."""
    by = _by(by)
    from ordlab.functions.scalar import trunc_int
    return df.groupBy(*by).agg(F.avg(F.when(trunc_int(a) == trunc_int(b), 1.0).otherwise(0.0)).alias(out))


def regression_errors(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """Rmse, mse, mae and explained variance."""
    by = _by(by)
    d = c(p).cast("double") - c(y).cast("double")
    g = df.groupBy(*by).agg(
        F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"),
        F.var_pop(c(y) - c(p)).alias("__vr"), F.var_pop(c(y)).alias("__vy"))
    return g.select(*by, F.sqrt("mse").alias("rmse"), "mse", "mae",
                    (F.lit(1.0) - safe_div("__vr", "__vy")).alias("explained_variance"))


def logloss(df: DataFrame, y: str, p: str, by=None, out: str = "logloss", eps: float = 1e-15) -> DataFrame:
    """Mean binary log-loss, probabilities clipped to [eps, 1-eps]."""
    by = _by(by)
    pp = clamp(p, eps, 1 - eps)
    yy = c(y).cast("double")
    return df.groupBy(*by).agg(
        F.avg(-(yy * F.ln(pp) + (F.lit(1.0) - yy) * F.ln(F.lit(1.0) - pp))).alias(out))


def auc(df: DataFrame, y: str, score: str, id_col: str, by=None, out: str = "auc") -> DataFrame:
    """Exact ROC AUC by the rank-sum statistic with tie-averaged ranks.

    Rows get a scalable global position in (score, id) order; a tie group of
    equal scores spans positions min..max, so its averaged 1-based rank is
    ``(min+max)/2 + 1``.  Only (group, distinct score) partial sums follow."""
    from ordlab.operators.rank import position
    by = _by(by)
    yy = F.when(c(y) > 0, 1).otherwise(0)
    p = position(df.select(*by, c(score).alias("__s"), c(id_col).alias("__id"), yy.alias("__y")),
                 ["__s", "__id"], "__r", partition_by=by or None)
    t = p.groupBy(*by, "__s").agg(F.min("__r").alias("__lo"), F.max("__r").alias("__hi"),
                                   F.sum("__y").alias("__pos"), F.count(F.lit(1)).alias("__cnt"))
    g = t.groupBy(*by).agg(
        F.sum(F.col("__pos") * ((F.col("__lo") + F.col("__hi")) / 2.0 + 1.0)).alias("__rs"),
        F.sum("__pos").alias("__p"), F.sum("__cnt").alias("__n"))
    u = F.col("__rs") - F.col("__p") * (F.col("__p") + 1) / 2.0
    return g.select(*by, safe_div(u, F.col("__p") * (F.col("__n") - F.col("__p"))).alias(out))
