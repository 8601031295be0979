"""All-pairs ranking gradient (L5) in linear rows.

Loss: the sum over all pairs with y_i > y_j of max(0, 1 - (s_i - s_j))^2, one global
group.  A row needs, for each lower label, count and sum of the scores above
s_i - 1, and for each higher label those below s_i + 1.  Rows and their two
questions are put in score order by ranges; running counts and sums per label
within a range, plus the totals of the ranges before it, answer them.  No pair is
formed; each row is three rows of the sort.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordlab.functions.scalar import c
from ordlab.session import fitted, materialize, shuffle_partitions


def pair_gradient(df: DataFrame, id_col: str, y: str, s: str, keep=()) -> DataFrame:
    """``(id, keep.., grad)``: the derivative of the whole loss by each row's score.
    Rows whose label or score is null have no pair and are left out; labels are
    whole numbers, ids are unique."""
    spark = df.sparkSession
    rows = df.select(c(id_col).alias("id"), *keep, c(y).cast("int").alias("y"), c(s).cast("double").alias("s")).filter("y is not null and s is not null")
    labels = [r[0] for r in rows.select("y").distinct().orderBy("y").collect()]  # ordered classes: a handful
    if not labels:
        return rows.select("id", *keep, F.lit(0.0).alias("grad"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("s") + F.lit(float(k))).alias("at")) for k in (-1, 0, 1)])).alias("e")
    events = rows.select("*", kinds).select("*", "e.kind", "e.at").drop("e")
    n = shuffle_partitions(spark)
    ranged = events.repartitionByRange(n, "at").sortWithinPartitions("at").select(
        "*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__n"))
    ranged = materialize(ranged, "ranking")  # bounds come from a sample: totals and rows must see the same ranges

    def parts(of) -> list[Column]:
        mine = [(F.col("kind") == 0) & (F.col("y") == v) for v in labels]
        return [of(F.when(m, 1).otherwise(0)).cast("double").alias(f"n{j}") for j, m in enumerate(mine)] + \
            [of(F.when(m, F.col("s")).otherwise(0.0)).alias(f"t{j}") for j, m in enumerate(mine)]

    names = [f"{a}{j}" for a in "nt" for j in range(len(labels))]
    # one row per range; the running totals are a window over that many rows
    totals = fitted(ranged.groupBy("__pid").agg(*parts(F.sum)), "ranges")
    up = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = fitted(totals.select("__pid", *[F.coalesce(F.sum(x).over(up), F.lit(0.0)).alias(f"b_{x}") for x in names]), "ranges")
    every = totals.agg(*[F.sum(x).alias(f"a_{x}") for x in names])
    w = Window.partitionBy("__pid").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.select("id", *keep, "y", "s", "kind", "__pid", *parts(lambda v: F.sum(v).over(w))).filter("kind <> 0")
    run = run.join(before, "__pid")
    one = every.select(F.struct("*").alias("a")).scalar()
    below = {x: F.col(x) + F.col(f"b_{x}") for x in names}
    grad = F.lit(0.0)
    for j, v in enumerate(labels):
        nj, tj = below[f"n{j}"], below[f"t{j}"]
        above_n, above_t = one[f"a_n{j}"] - nj, one[f"a_t{j}"] - tj
        # kind -1 asks for scores above s - 1 of lower labels, kind 1 for scores below s + 1 of higher ones
        grad = grad + F.when((F.col("kind") == -1) & (F.col("y") > v), F.lit(-2.0) * ((F.lit(1.0) - F.col("s")) * above_n + above_t)) \
            .when((F.col("kind") == 1) & (F.col("y") < v), F.lit(2.0) * ((F.lit(1.0) + F.col("s")) * nj - tj)).otherwise(0.0)
    return run.select("id", *keep, "s", grad.alias("g")).groupBy("id", *keep).agg(F.sum("g").alias("grad"))


def pairwise_fit(df: DataFrame, features, label: str, id_col: str, iters: int = 15, rate: float = 0.5, l2: float = 1e-4):
    """A linear score trained on all pairs by normalised gradient steps.  The
    gradient by the coefficients is ``sum_i grad_i x_i``, one aggregate a step.
    Returns the coefficients of the raw features."""
    feats = list(features)
    mom = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(feats)], *[F.stddev_pop(f).alias(f"d{i}") for i, f in enumerate(feats)]).first()
    mean = np.array([mom[f"m{i}"] or 0.0 for i in range(len(feats))])
    dev = np.array([mom[f"d{i}"] or 1.0 for i in range(len(feats))])
    z = [f"z{i}" for i in range(len(feats))]
    rows = materialize(df.select(c(id_col).alias("id"), c(label).alias("y"), *[((F.col(f) - float(mean[i])) / float(dev[i])).alias(z[i])
                                                                              for i, f in enumerate(feats)]), "ranking-rows")
    w = np.zeros(len(feats))
    for t in range(iters):
        score = F.lit(0.0)
        for i, name in enumerate(z):
            score = score + F.lit(float(w[i])) * F.col(name)
        g = pair_gradient(rows.withColumn("s", score), "id", "y", "s", keep=z)
        r = g.agg(*[F.sum(F.col("grad") * F.col(name)).alias(name) for name in z]).first()
        step = np.array([r[name] or 0.0 for name in z])
        size = np.linalg.norm(step)
        if size == 0:
            break
        w = w - rate / math.sqrt(t + 1) * step / size - l2 * w
    return w / dev
