"""Blending, voting and greedy ensemble selection.

Predictions are kept in the long form ``(model, run, id, prediction, target)``.
A greedy round is one distributed job: the current blend is joined to every
candidate model's predictions on ``(run, id)``, candidate weights come from a
parameter list (explode), blends are decoded and scored per (candidate, run),
and only the winning (model, weight) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordlab.functions.scalar import c
from ordlab.operators.decode import decode_cdf
from ordlab.operators.metrics import qwk
from ordlab.session import materialize, shuffle_partitions


def blend_weighted(preds: DataFrame, weights: DataFrame, key=("id",), model: str = "model",
                   p: str = "prediction", w: str = "weight", out: str = "blend") -> DataFrame:
    """``sum w p / sum w`` per key; ``weights`` has one row per model."""
    key = list(key)
    j = preds.join(F.broadcast(weights), model)  # one row per model: bounded by the model count
    return j.groupBy(*key).agg((F.sum(c(w) * c(p)) / F.sum(c(w))).alias(out))


def running_blend(preds: DataFrame, order: str, key=("id",), p: str = "prediction", w: str = "weight",
                  out: str = "blend") -> DataFrame:
    """The running weighted mean over an ordered list of models, per key:
    after model j the blend is ``sum_{i<=j} w_i p_i / sum_{i<=j} w_i``.  The
    window is partitioned by the row key (one small group per row)."""
    from pyspark.sql import Window
    win = Window.partitionBy(*list(key)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return preds.withColumn(out, F.sum(F.col(w) * F.col(p)).over(win) / F.sum(w).over(win))


def bag_average(preds: DataFrame, key=("id",), p: str = "prediction", out: str = "avg") -> DataFrame:
    """Mean prediction over bags."""
    return preds.groupBy(*list(key)).agg(F.avg(p).alias(out))


def vote_majority(cols) -> "F.Column":
    """The most frequent class among ``cols``, lowest class on ties."""
    from ordlab.functions.scalar import row_vote
    return row_vote(cols)


def vote_agreement(c1, c2, c3) -> "F.Column":
    """A class that has at least two of three votes, else the first model's."""
    a, b, d = c(c1), c(c2), c(c3)
    return (F.when((a == b) | (a == d), a).when(b == d, b).otherwise(a))


def top_k_per_group(df: DataFrame, by, order, k: int, tie: str, salt_buckets: int = 64,
                    out: str = "rank") -> DataFrame:
    """Top ``k`` rows per group in ``order`` (descending), ties by ``tie``.

    A group may hold a third of the rows, so a first window keeps the top k
    inside each (group, hash-salt) slice — many balanced tasks — and the final
    window ranks at most ``salt_buckets * k`` survivors per group.  Exact:
    the group's top k is contained in the union of the slices' top k."""
    by = list(by)
    o = [F.desc(order), F.asc(tie)]
    salted = df.withColumn("__salt", F.abs(F.xxhash64(c(tie))) % F.lit(salt_buckets))
    w1 = Window.partitionBy(*by, "__salt").orderBy(*o)
    pre = salted.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= k).drop("__r", "__salt")
    w2 = Window.partitionBy(*by).orderBy(*o)
    return pre.withColumn(out, F.row_number().over(w2)).filter(F.col(out) <= k)


def _decode_and_score(blend: DataFrame, cdf: DataFrame, by, pred: str = "blend") -> DataFrame:
    dec = decode_cdf(blend, pred, "id", cdf, by=by, out="cls", cdf_by=["run"])
    return qwk(dec, "target", "cls", by=by)


def candidate_scores(preds: DataFrame, current: DataFrame | None, current_weight: float,
                     weights, cdf: DataFrame) -> DataFrame:
    """Score every (model, weight) added to the current blend.

    ``preds``: ``(model, run, id, prediction, target)``; ``current``:
    ``(run, id, blend)`` or None; ``cdf``: ``(run, cls, cdf)`` per run.
    Returns ``(model, weight, kappa_mean)``."""
    wt = F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("weight")
    cand = preds.select("model", "run", "id", "prediction", "target")
    if current is not None:
        # dealt by the join's keys and joined once; the decoder reads the rows of all weights from it several times
        cand = cand.repartition(shuffle_partitions(preds.sparkSession), "run", "id")
        cand = materialize(cand.join(current, ["run", "id"]), "candidates")
    cand = cand.select("*", wt)
    if current is not None:
        cand = (cand
                .withColumn("blend", (F.col("blend") * F.lit(current_weight) + F.col("weight") * F.col("prediction"))
                            / (F.lit(current_weight) + F.col("weight"))))
    else:
        cand = cand.withColumn("blend", F.col("prediction"))
    dec = decode_cdf(cand.select("model", "weight", "run", "id", "blend", "target"), "blend", "id", cdf,
                     by=["model", "weight", "run"], out="cls", cdf_by=["run"])
    k = qwk(dec, "target", "cls", by=["model", "weight", "run"])
    return k.groupBy("model", "weight").agg(F.avg("kappa").alias("kappa_mean"))


def greedy_selection(preds: DataFrame, cdf: DataFrame, weights=(0.25, 0.5, 1.0), init_top_k: int = 1,
                     tol: float = 1e-9):
    """Greedy ensemble selection with replacement.

    Starts from the mean of the ``init_top_k`` best single models, then each
    round adds the (model, weight) that raises the mean kappa most; stops when
    nothing improves.  Returns the list of ``(round, model, weight, kappa)``."""
    singles = candidate_scores(preds, None, 0.0, [1.0], cdf).orderBy(F.desc("kappa_mean"), "model")
    top = singles.limit(init_top_k).collect()  # a handful of winners
    chosen = [(0, r["model"], 1.0, float(r["kappa_mean"])) for r in top]
    names = [r["model"] for r in top]
    cur = (preds.filter(F.col("model").isin(names)).groupBy("run", "id")
           .agg(F.avg("prediction").alias("blend")))
    total_w = float(len(names))
    best = chosen[-1][3] if chosen else float("-inf")
    if init_top_k > 1:
        best = float(_decode_and_score(
            cur.join(preds.select("run", "id", "target").distinct(), ["run", "id"]), cdf, ["run"])
            .agg(F.avg("kappa")).first()[0])
    rnd = 0
    while True:
        rnd += 1
        sc = candidate_scores(preds, cur, total_w, weights, cdf)
        win = sc.orderBy(F.desc("kappa_mean"), "model", "weight").first()
        if win is None or win["kappa_mean"] <= best + tol:
            break
        best = float(win["kappa_mean"])
        m, w = win["model"], float(win["weight"])
        chosen.append((rnd, m, w, best))
        add = preds.filter(F.col("model") == m).select("run", "id", F.col("prediction").alias("__p"))
        cur = (cur.join(add, ["run", "id"])
               .select("run", "id", ((F.col("blend") * F.lit(total_w) + F.lit(w) * F.col("__p"))
                                     / F.lit(total_w + w)).alias("blend")))
        cur = materialize(cur, "ensemble")  # cut the growing lineage every round
        total_w += w
    return chosen
