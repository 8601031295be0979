"""Decoders from a real-valued score (or class scores) to ordered classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordlab.functions.scalar import c, expected_class, half_away, trunc_int
from ordlab.operators.frame import attach, match
from ordlab.operators.orderstats import keyed, rank_keys, spread
from ordlab.session import fitted


def decode_cdf(df: DataFrame, score: str, id_col: str, cdf: DataFrame, by=None,
               out: str = "cls", strict: bool = True, cls_col: str = "cls",
               cdf_col: str = "cdf", n_classes: int = 8, cdf_by=None) -> DataFrame:
    """Give the lowest-ranked ``cdf_1`` share class 1, the next share class 2, ...

    A row's rank is its place by ``(score, id)`` inside its ``by`` group (ids that
    are no whole numbers go by their hash).  Only the rows at the class boundaries are looked for
    (``orderstats.rank_keys``), and each row is then compared with them: nothing is
    sorted or written.  Rows of equal score and id get one class.  With ``strict``
    the reference's slice ends ``int(n*cdf_k - 1)`` are kept, so the row just below
    each boundary stays in the last class (Q1); ``strict=False`` closes the gaps.
    ``cdf`` has columns ``cdf_by + [cls_col, cdf_col]`` (``cdf_by`` defaults to
    ``by``) with ``n_classes`` rows per group.
    """
    by = list(by or [])
    cdf_by = list(by if cdf_by is None else cdf_by)
    rows = keyed(df, score, id_col)
    shares = (cdf.groupBy(*cdf_by)
                 .agg(F.array_sort(F.collect_list(F.struct(F.col(cls_col).alias("k"),
                                                           F.col(cdf_col).cast("double").alias("f"))))
                      .alias("__cdf")))
    n = F.col("n").cast("double")

    def bounds(k):
        f = F.col("__cdf")[k - 1]["f"]
        pf = F.col("__cdf")[k - 2]["f"] if k > 1 else F.lit(0.0)
        lo = F.lit(0).cast("bigint") if k == 1 else F.floor(n * pf)
        hi = F.floor(F.greatest(n * f - F.lit(1.0), F.lit(0.0))) if strict else F.floor(n * f)
        return lo, hi

    ends = [x for k in range(1, n_classes) for x in bounds(k)]

    def class_at(r) -> Column:
        out_ = F.lit(n_classes)
        for k in range(n_classes - 1, 0, -1):
            lo, hi = (F.col("__ends")[2 * k - 2 + j] for j in (0, 1))
            out_ = F.when((r >= lo) & (r < hi), F.lit(k)).otherwise(out_)
        return out_

    def boundary_ranks(groups: DataFrame) -> DataFrame:
        g = groups.join(shares, cdf_by) if cdf_by else attach(groups, shares)
        return g.withColumn("__ends", F.array(*ends)).drop("__cdf")

    sizes, at = rank_keys(rows.select(*by, "__v", "__i"), by, boundary_ranks)
    at = at.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("v", "i", "rank"))).alias("__at"))
    found = match(sizes, at, by) if by else attach(sizes, at)
    # per group the keys of the boundary rows in order, and the class from each on (rank 0 is the first).  They stay
    # one array: as columns they make a generated method that is too long to be compiled
    found = found.select(*by, F.transform("__at", lambda x: F.struct(x.v.alias("v"), x.i.alias("i"))).alias("__keys"),
                         F.transform("__at", lambda x: class_at(x["rank"])).alias("__cls"))
    both = spread(rows, fitted(found, "boundaries"), by)
    v, i = F.col("__v"), F.col("__i")
    passed = F.size(F.filter("__keys", lambda x: (v > x.v) | ((v == x.v) & (i >= x.i)))) - 1
    both = both.withColumn(out, F.get("__cls", passed).cast("int"))
    return both.select(*df.columns, *([] if out in df.columns else [out]))


def decode_cut(score, cuts) -> Column:
    """Right-closed bins ``(c_{k-1}, c_k]`` -> ``1 + sum_k [score > c_k]``.

    ``cuts`` is a list of numbers or an array column (sorted or not).  A score
    that is null or not a number has no class."""
    s = c(score)
    if isinstance(cuts, (list, tuple)):
        out = F.lit(1)
        for v in cuts:
            out = out + F.when(s > F.lit(float(v)), 1).otherwise(0)
    else:
        out = F.lit(1) + F.size(F.filter(c(cuts), lambda x: s > x))
    return F.when(s.isNotNull() & ~F.isnan(s.cast("double")), out.cast("int"))


def decode_cut3(score, cutoff=(None, None, None), default: int = 4) -> Column:
    """D3: ``<= c0`` -> 1, ``<= c1`` -> 2, ``<= c2`` -> 3, else ``default``."""
    s = c(score)
    return (F.when(s <= F.lit(float(cutoff[0])), 1).when(s <= F.lit(float(cutoff[1])), 2)
             .when(s <= F.lit(float(cutoff[2])), 3).otherwise(default).cast("int"))


def decode_expected(df: DataFrame, probs: str, id_col: str, cdf: DataFrame, by=None,
                    out: str = "cls", **kw) -> DataFrame:
    """Expected class ``sum_k k p_k`` then the CDF decode."""
    tmp = df.withColumn("__ev", expected_class(probs))
    return decode_cdf(tmp, "__ev", id_col, cdf, by=by, out=out, **kw).drop("__ev")


def decode_ebc(scores, hard: bool = False, n_thresholds: int = 7) -> Column:
    """``1 + sum_{k<=7} p_k`` (soft) or ``1 + sum_k [p_k > 0]`` (hard)."""
    a = F.slice(c(scores), 1, n_thresholds)
    if hard:
        return (F.lit(1) + F.size(F.filter(a, lambda x: x > 0))).cast("int")
    return F.lit(1.0) + F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def decode_cocr(scores) -> Column:
    """``1 + sum_k p_k`` over all class scores."""
    return F.lit(1.0) + F.aggregate(c(scores), F.lit(0.0), lambda acc, x: acc + x)


def decode_round(score, lo: int = 1, hi: int = 8) -> Column:
    """Below ``lo`` -> lo, above ``hi`` -> hi, a rounded 3 becomes 2,
    otherwise half-away rounding (the reference's builtin ``round``)."""
    s = c(score)
    r = trunc_int(half_away(s))
    return (F.when(s < lo, F.lit(lo)).when(s > hi, F.lit(hi))
             .when(r == 3, F.lit(2)).otherwise(r).cast("int"))


def cutpoints_mean(cuts: DataFrame, k: str = "k", cut: str = "cut", by=None) -> DataFrame:
    """Cut points averaged over runs, one row per cut index."""
    by = list(by or [])
    return cuts.groupBy(*by, k).agg(F.avg(cut).alias(cut))


def cut_array(cuts: DataFrame, k: str = "k", cut: str = "cut", by=None, out: str = "cuts") -> DataFrame:
    """Fold a ``(k, cut)`` table into one sorted array per group (T4)."""
    by = list(by or [])
    return cuts.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(c(k).alias("k"), c(cut).alias("v")))),
                    lambda s: s["v"]).alias(out))
