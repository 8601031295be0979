"""FTRL-proximal linear learners (L15-L19) on long ``(id, feature, value)`` rows.

The model state is a table ``(feature, z, n, w)`` — one row per feature, the
size of the model, never of the data.  One mini-batch step is two grouped
aggregates: the margin of each row (rows joined to the weights on
``feature``) and the gradient of each feature (``sum (p - y) x`` over the
batch).  The state update is column arithmetic on the joined state.
Batches are sequential by definition, so the parallelism is inside a batch
(rows x features); the state is written to the shared checkpoint folder
every few batches to cut the lineage.

A batch of a few thousand values is no work for a cluster, and a job per batch
would make the jobs grow with the rows.  ``fit`` therefore hands runs of such
batches, at most ``RUN_VALUES`` values together, with the state to one task each,
which takes the same steps (``run_steps``); larger batches are one job each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import sigmoid, uniform
from ordlab.session import materialize, shuffle_partitions

#: values of a run of batches that one task takes, and rows of a state that goes with each run
RUN_VALUES, RUN_FEATURES = 1 << 20, 1 << 18


@dataclass
class FtrlParams:
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    link: str = "logistic"        # "identity" for the regressor (L15)
    dropout: float = 0.0          # L19: target mask probability of a zero, off by default
    seed: int = 1


def zero_state(long: DataFrame, feature: str = "feature") -> DataFrame:
    return (long.select(feature).distinct()
            .select(feature, F.lit(0.0).alias("z"), F.lit(0.0).alias("n"), F.lit(0.0).alias("w")))


def predict(long: DataFrame, state: DataFrame, link: str = "logistic") -> DataFrame:
    """``(id, p)``: ``p = link(sum_f w_f x_f)``; unknown features weigh 0."""
    m = (long.join(state.select("feature", "w"), "feature", "left")
             .groupBy("id").agg(F.sum(F.coalesce(F.col("w"), F.lit(0.0)) * F.col("value")).alias("margin")))
    p = sigmoid(F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("margin")))) if link == "logistic" \
        else F.col("margin")
    return m.select("id", p.alias("p"))


def update(state: DataFrame, grad: DataFrame, prm: FtrlParams) -> DataFrame:
    """L17 on the state table: ``sigma = (sqrt(n+g^2)-sqrt(n))/alpha``,
    ``z += g - sigma w``, ``n += g^2``, then ``w`` from ``z, n`` with the L1
    zero zone.  sigma and z use the old n and w."""
    j = state.join(grad, "feature", "left").withColumn("g", F.coalesce(F.col("g"), F.lit(0.0)))
    g, z, n, w = F.col("g"), F.col("z"), F.col("n"), F.col("w")
    sigma = (F.sqrt(n + g * g) - F.sqrt(n)) / F.lit(prm.alpha)
    z2 = z + g - sigma * w
    n2 = n + g * g
    w2 = F.when(F.abs(z2) <= F.lit(prm.l1), F.lit(0.0)).otherwise(
        (F.signum(z2) * F.lit(prm.l1) - z2) / ((F.lit(prm.beta) + F.sqrt(n2)) / F.lit(prm.alpha) + F.lit(prm.l2)))
    return j.select("feature", z2.alias("z"), n2.alias("n"), w2.alias("w"))


def _target(prm: FtrlParams) -> Column:
    """The label as a number, masked to zero at random with ``dropout``."""
    y = F.col("y").cast("double")
    if prm.dropout:
        y = y * F.when(uniform("id", prm.seed) >= F.lit(prm.dropout), 1.0).otherwise(0.0)
    return y


def gradient(long_batch: DataFrame, labels_batch: DataFrame, state: DataFrame, prm: FtrlParams,
             weight: str | None = None) -> DataFrame:
    """``(feature, g)`` with ``g = sum_rows (p - y) x`` (a sum, not a mean)."""
    p = predict(long_batch, state, prm.link)
    diff = F.col("p") - _target(prm)
    if weight:
        diff = diff * F.col(weight)
    d = p.join(labels_batch, "id").select("id", diff.alias("d"))
    return long_batch.join(d, "id").groupBy("feature").agg(F.sum(F.col("d") * F.col("value")).alias("g"))


def step(long_batch, labels_batch, state, prm: FtrlParams, weight=None) -> DataFrame:
    return update(state, gradient(long_batch, labels_batch, state, prm, weight), prm)


def run_steps(rows: pd.DataFrame, state: pd.DataFrame, prm: FtrlParams) -> pd.DataFrame:
    """``step`` for each batch of ``rows`` (``batch, id, feature, value, y``) in order.
    A feature without a gradient in a batch keeps z and n, hence its weight."""
    z, n, w = (state[k].to_numpy(dtype=float).copy() for k in "znw")

    def weights(z, n):
        with np.errstate(invalid="ignore"):
            return np.where(np.abs(z) <= prm.l1, 0.0, (np.sign(z) * prm.l1 - z) / ((prm.beta + np.sqrt(n)) / prm.alpha + prm.l2))

    rows = rows.sort_values(["batch", "id"], kind="stable")
    at = pd.Index(state["feature"]).get_indexer(rows["feature"])  # -1 weighs nothing and has no gradient
    x, y, ids, batch = (rows[k].to_numpy() for k in ("value", "y", "id", "batch"))
    ends = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1], True]) if len(rows) else [0]
    touched = np.arange(len(z))  # at first all weights follow from z and n
    for a, b in zip(ends, ends[1:]):
        xb, fb, known = x[a:b], at[a:b], at[a:b] >= 0
        row = np.cumsum(np.r_[False, ids[a + 1:b] != ids[a:b - 1]])
        margin = np.bincount(row, np.where(known, w[fb], 0.0) * xb) if len(w) else np.zeros(row[-1] + 1)
        p = 1.0 / (1.0 + np.exp(-np.where(np.isnan(margin), 35.0, np.clip(margin, -35.0, 35.0)))) if prm.link == "logistic" else margin
        g = np.bincount(fb[known], ((p[row] - y[a:b]) * xb)[known], len(z))
        f = np.union1d(fb[known], touched)
        sigma = (np.sqrt(n[f] + g[f] * g[f]) - np.sqrt(n[f])) / prm.alpha
        z[f] += g[f] - sigma * w[f]
        n[f] += g[f] * g[f]
        w[f] = weights(z[f], n[f])
        touched = f[:0]
    w[touched] = weights(z[touched], n[touched])
    return pd.DataFrame({"feature": state["feature"], "z": z, "n": n, "w": w})


def _run(rows: DataFrame, state: DataFrame, prm: FtrlParams) -> DataFrame:
    """The state after a run of batches (a bounded number of rows) in one task.
    Rows without a feature, a value or a label add nothing in a step, either."""
    one = F.lit(0).alias("__g")
    full = rows.filter("feature is not null and value is not null and y is not null")
    full = full.select(one, "batch", "id", "feature", F.col("value").cast("double").alias("value"), "y").groupBy("__g")
    feature = state.schema["feature"].dataType.simpleString()
    return full.cogroup(state.select(one, "feature", "z", "n", "w").groupBy("__g")).applyInPandas(
        lambda r, s: run_steps(r, s, prm), f"feature {feature}, z double, n double, w double")


def single_pass(long: DataFrame, labels: DataFrame, prm: FtrlParams, batch_size: int, state: DataFrame | None = None) -> DataFrame | None:
    """The state after one pass of ``fit`` over so few rows that one task takes all
    their batches: one count and one job, whatever the number of batches.  Features
    that ``state`` lacks start from zero.  None if there are too many values, labels
    or features for a run, or ids that the task would not put in Spark's order."""
    kind = dict(labels.dtypes)["id"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "string") or dict(long.dtypes)["id"] != kind:
        return None
    zero = F.lit("" if kind == "string" else 0).cast(kind)
    name = (long if state is None else state).schema["feature"].dataType.simpleString()

    def part(df, k, id_, feature, a, b, c):  # values and their use; labels, those with y, those with an id; z, n, w
        return df.select(F.lit(k).alias("k"), F.coalesce(id_, zero).alias("id"), feature.cast(name).alias("feature"),
                         *[x.cast("double").alias(y) for x, y in ((a, "a"), (b, "b"), (c, "c"))])

    id_, feature, value, none = F.col("id"), F.col("feature"), F.col("value"), F.lit(None)
    full = id_.isNotNull() & feature.isNotNull() & value.isNotNull()
    target = _target(prm)
    rows = part(long, 0, id_, feature, value, full, none).unionByName(
        part(labels, 1, id_, none, target, target.isNotNull(), id_.isNotNull()))
    if state is not None:
        rows = rows.unionByName(part(state, 2, none, feature, F.col("z"), F.col("n"), F.col("w")))
    count = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    if max(count.get(0, 0), count.get(1, 0)) > RUN_VALUES or count.get(2, 0) > RUN_FEATURES:
        return None

    def steps(group):
        x, y, old = (group[group["k"] == k] for k in range(3))
        y = y.sort_values(["c", "id"], kind="stable")  # null ids first
        y = y.assign(batch=np.arange(len(y)) // batch_size)
        y = y[(y["b"] > 0) & (y["c"] > 0)]
        new = x["feature"].drop_duplicates()
        new = new[~new.isin(old["feature"])]
        start = {k: np.r_[old[c].to_numpy(), np.zeros(len(new))] for k, c in zip("znw", "abc")}
        start = pd.DataFrame({"feature": [*old["feature"], *new]} | start)
        x = x.loc[x["b"] > 0, ["id", "feature", "a"]].rename(columns={"a": "value"})
        return run_steps(x.merge(y[["id", "a", "batch"]].rename(columns={"a": "y"}), on="id"), start, prm)

    return rows.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(steps, f"feature {name}, z double, n double, w double")


def fit(long: DataFrame, labels: DataFrame, prm: FtrlParams, batch_size: int, epochs: int = 1,
        state: DataFrame | None = None, checkpoint_every: int = 4, valid_long: DataFrame | None = None,
        valid_labels: DataFrame | None = None, metric: str = "logloss", early_stop_rounds: int | None = None):
    """Mini-batch FTRL over ``labels`` in id order (W6 batches), ``epochs``
    passes, warm start from ``state`` (L18).  With a validation set the best
    epoch's state is kept and training stops after ``early_stop_rounds``
    epochs without improvement.  Returns ``(state, history)``."""
    from ordlab.operators.rank import batches
    lab = materialize(batches(labels, ["id"], batch_size), "ftrl-labels")
    n_batches = lab.agg(F.max("batch")).first()[0]
    n_batches = 0 if n_batches is None else int(n_batches) + 1
    # batch order, so that a step reads its batches by the files' statistics
    parts = max(min(max(shuffle_partitions(long.sparkSession), n_batches // 64), n_batches), 1)
    rows = long.join(lab.select("id", "batch", _target(prm).alias("y")), "id").select("batch", "id", "feature", "value", "y")
    rows = materialize(rows.repartitionByRange(parts, "batch").sortWithinPartitions("batch"), "ftrl-rows")
    st = state if state is not None else zero_state(long)
    st = materialize(st, "ftrl-state")
    most = rows.groupBy("batch").count().agg(F.max("count")).first()[0] or 1
    # batches of a run; 0 if they are large enough for a job each
    width = RUN_VALUES // most if st.count() <= RUN_FEATURES else 0
    history, best, best_state, since = [], None, st, 0
    done = 0
    for ep in range(epochs):
        for b in range(0, n_batches, width) if width else ():
            st = materialize(_run(rows.filter(F.col("batch").between(b, b + width - 1)), st, prm), "ftrl-state")
        for b in range(n_batches) if not width else ():
            st = step(rows.filter(F.col("batch") == b), lab.filter(F.col("batch") == b), st, prm)
            done += 1
            if done % checkpoint_every == 0:
                st = materialize(st, "ftrl-state")
        st = materialize(st, "ftrl-state")
        if valid_long is not None:
            val = evaluate(valid_long, valid_labels, st, prm.link, metric)
            history.append((ep, val))
            better = best is None or (val < best if metric in ("logloss", "rmse") else val > best)
            if better:
                best, best_state, since = val, st, 0
            else:
                since += 1
                if early_stop_rounds and since >= early_stop_rounds:
                    break
    return (best_state if valid_long is not None else st), history


def evaluate(long: DataFrame, labels: DataFrame, state: DataFrame, link: str, metric: str) -> float:
    """UD3: a named metric of the model on ``(long, labels)``."""
    from ordlab.operators import metrics as mt
    p = predict(long, state, link).join(labels, "id")
    if metric == "logloss":
        r = mt.logloss(p, "y", "p").first()[0]
    elif metric == "auc":
        r = mt.auc(p, "y", "p", "id").first()[0]
    elif metric == "rmse":
        r = mt.regression_errors(p, "y", "p").first()["rmse"]
    else:
        raise ValueError(metric)
    return float(r)


def one_vs_rest_long(labels: DataFrame, classes) -> DataFrame:
    """L16 multiclass: one binary target per class, state keyed ``(feature, cls)``
    by prefixing the class to the feature (independent sigmoids)."""
    return labels.select("id", F.explode(F.array(*[F.lit(int(k)) for k in classes])).alias("cls"), "y") \
        .select(F.concat_ws("#", "id", "cls").alias("id"), "cls", (F.col("y") == F.col("cls")).cast("double").alias("y"))
