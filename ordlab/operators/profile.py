"""Aggregations (A1-A19): column profiles, class histograms and CDFs,
run statistics.  Wide profiles are one aggregate over all columns followed by
an unpivot, never one job per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordlab.functions.scalar import c


def null_profile(df: DataFrame, cols=None, threshold: float = 0.1) -> DataFrame:
    """Null rate of every column in one pass, unpivoted to
    ``(column, null_rate, flagged)``; ``flagged`` = rate > threshold."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.avg(F.col(x).isNull().cast("double")).alias(x) for x in cols])
    long = wide.unpivot([], cols, "column", "null_rate")
    return long.withColumn("flagged", F.col("null_rate") > F.lit(threshold))


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """A4."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def group_sum(df: DataFrame, key: str, value: str, out: str = "total") -> DataFrame:
    """A5."""
    return df.groupBy(key).agg(F.sum(value).alias(out))


def class_hist(df: DataFrame, label: str, by=None, n_classes: int = 8, first: int = 1) -> DataFrame:
    """Zero-filled class histogram over ``first..first+n_classes-1``.

    The class grid comes from the distinct group keys of the count table
    (one row per group), so the zero-fill never touches the data rows again."""
    by = list(by or [])
    counts = df.groupBy(*by, c(label).cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("cnt"))
    # group keys come from the (small) count table, not from another pass over the rows
    keys = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = keys.withColumn("cls", F.explode(F.sequence(F.lit(first), F.lit(first + n_classes - 1))))
    return (grid.join(counts, by + ["cls"], "left")
                .select(*by, "cls", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")))


def class_cdf(df: DataFrame, label: str, by=None, n_classes: int = 8, first: int = 1) -> DataFrame:
    """Class share ``pdf`` and cumulative share ``cdf`` per group.

    ``cdf`` is ``running count / total`` (count over count, as the reference);
    the window runs over the class table only (n_classes rows per group)."""
    by = list(by or [])
    h = class_hist(df, label, by, n_classes, first)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = part.orderBy("cls").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = F.sum("cnt").over(part).cast("double")
    return h.select(*by, "cls", "cnt", (F.col("cnt") / tot).alias("pdf"),
                    (F.sum("cnt").over(run) / tot).alias("cdf"))


def mean_cdf_pdf(cdfs: DataFrame, over: str = "run", cls: str = "cls", cdf: str = "cdf",
                 by=None) -> DataFrame:
    """Average the CDF over ``over`` (e.g. folds), then differences back to a PDF."""
    by = list(by or [])
    m = cdfs.groupBy(*by, cls).agg(F.avg(cdf).alias("cdf"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return m.select(*by, cls, "cdf",
                    (F.col("cdf") - F.coalesce(F.lag("cdf").over(part.orderBy(cls)), F.lit(0.0))).alias("pdf"))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """A11."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct values (ordering applied at write/collect time)."""
    return df.select(col).distinct().orderBy(col)


def mean_std(df: DataFrame, value: str, by=None, prefix: str = "") -> DataFrame:
    """Mean and population std over runs."""
    by = list(by or [])
    return df.groupBy(*by).agg(F.avg(value).alias(prefix + "mean"),
                               F.stddev_pop(value).alias(prefix + "std"))


def best_row(df: DataFrame, score: str, tie: str, by=None, carry=None) -> DataFrame:
    """The row with max ``score`` (ties: smallest ``tie``), via ``max_by``
    on a struct so it is a plain partial aggregate."""
    by = list(by or [])
    carry = list(carry or [x for x in df.columns if x not in by])
    key = F.struct(c(score).alias("s"), (-c(tie)).alias("t")) if tie else c(score)
    best = df.groupBy(*by).agg(F.max_by(F.struct(*carry), key).alias("__b"))
    return best.select(*by, *[F.col("__b")[x].alias(x) for x in carry])


def normalized(df: DataFrame, value: str, mode: str = "sum", out: str = "share") -> DataFrame:
    """``v / sum(v)`` or ``v / max(v)``; the input is an importance
    table with one row per feature (bounded by the feature count)."""
    from ordlab.operators.frame import scalar
    total = scalar(df.agg((F.sum(value) if mode == "sum" else F.max(value)).alias("__t")), "__t")
    return df.withColumn(out, F.col(value) / total)
