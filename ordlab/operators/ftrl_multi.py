"""Multiclass FTRL-proximal learner (L16, L15, L18) with one state for all classes.

The state is a table ``(feature, z, n, w)`` whose last three columns are arrays with
an entry per class, so its key is (feature, class).  A batch is one margin
aggregate and one gradient aggregate for all classes together; classes are
independent sigmoids, and probabilities are the normalised ones.  Rows can carry
weights.  The training rows are written once, in batch order, and a step reads its
batch by the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import sigmoid
from ordlab.operators.ftrl import FtrlParams
from ordlab.session import materialize, shuffle_partitions


def zero_state(long: DataFrame, classes) -> DataFrame:
    zero = F.array(*[F.lit(0.0)] * len(classes))
    return long.select("feature").distinct().select("feature", zero.alias("z"), zero.alias("n"), zero.alias("w"))


def _sums(value, k: int) -> list[Column]:
    """Sum of each array entry as a column of its own (a partial aggregate)."""
    return [F.sum(value(j)).alias(f"s{j}") for j in range(k)]


def _packed(k: int) -> Column:
    return F.array(*[F.col(f"s{j}") for j in range(k)])


def margins(long: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """``(id, m)``: the margin of every class; an unknown feature weighs 0."""
    j = long.join(state.select("feature", "w"), "feature", "left")
    return j.groupBy("id").agg(*_sums(lambda c: F.coalesce(F.get("w", F.lit(c)), F.lit(0.0)) * F.col("value"), k)).select("id", _packed(k).alias("m"))


def probabilities(long: DataFrame, state: DataFrame, classes) -> DataFrame:
    """``(id, p, cls)``: sigmoids divided by their sum, and the likeliest class (the lowest of equals)."""
    p = F.transform("m", lambda x: sigmoid(F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x))))
    d = margins(long, state, len(classes)).select("id", p.alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(int(c)) for c in classes])
    return d.select("id", F.transform("q", lambda x: x / total).alias("p"), names[(F.array_position("q", F.array_max("q")) - 1).cast("int")].alias("cls"))


def gradient(long: DataFrame, labels: DataFrame, state: DataFrame, classes, weight: str | None = None) -> DataFrame:
    """``(feature, g)``: per class the sum over rows of weight times (p - [y = class]) times value."""
    k = len(classes)
    names = F.array(*[F.lit(int(c)) for c in classes])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = margins(long, state, k).join(labels.select("id", "y", w.alias("__w")), "id")
    diff = F.zip_with("m", names, lambda m, c: F.col("__w") * (
        sigmoid(F.greatest(F.lit(-35.0), F.least(F.lit(35.0), m))) - F.when(F.col("y") == c, 1.0).otherwise(0.0)))
    j = long.join(d.select("id", diff.alias("d")), "id")
    return j.groupBy("feature").agg(*_sums(lambda c: F.col("d")[c] * F.col("value"), k)).select("feature", _packed(k).alias("g"))


def step(long: DataFrame, labels: DataFrame, state: DataFrame, prm: FtrlParams, classes, weight: str | None = None) -> DataFrame:
    """L17 for every class: sigma and z use the old n and w; |z| <= l1 gives weight 0."""
    zero = F.array(*[F.lit(0.0)] * len(classes))
    j = state.join(gradient(long, labels, state, classes, weight), "feature", "left").withColumn("g", F.coalesce("g", zero))
    one = F.transform(F.arrays_zip("g", "z", "n", "w"), lambda x: F.struct(
        (x.z + x.g - (F.sqrt(x.n + x.g * x.g) - F.sqrt(x.n)) / F.lit(prm.alpha) * x.w).alias("z"), (x.n + x.g * x.g).alias("n")))
    j = j.select("feature", one.alias("u"))
    w = F.transform("u", lambda x: F.when(F.abs(x.z) <= prm.l1, F.lit(0.0)).otherwise(
        (F.signum(x.z) * prm.l1 - x.z) / ((F.lit(prm.beta) + F.sqrt(x.n)) / F.lit(prm.alpha) + F.lit(prm.l2))))
    return j.select("feature", F.col("u.z").alias("z"), F.col("u.n").alias("n"), w.alias("w"))


def fit(long: DataFrame, labels: DataFrame, prm: FtrlParams, classes, batch_size: int, epochs: int = 1, state: DataFrame | None = None,
        weight: str | None = None, checkpoint_every: int = 4, valid_long: DataFrame | None = None, valid_labels: DataFrame | None = None,
        early_stop_rounds: int | None = None) -> tuple[DataFrame, list[float]]:
    """Mini-batches of ``labels`` in id order; warm start from ``state``.  With a
    validation set the best epoch's state (by accuracy) is returned and training
    stops after ``early_stop_rounds`` epochs without a better one."""
    from ordlab.operators.rank import batches
    lab = materialize(batches(labels, ["id"], batch_size), "ftrl-labels")
    n = lab.agg(F.max("batch")).first()[0]
    count = -1 if n is None else int(n)
    parts = min(shuffle_partitions(long.sparkSession), count + 1) or 1
    rows = long.join(lab.select("id", "batch"), "id")
    rows = materialize(rows.repartitionByRange(parts, "batch").sortWithinPartitions("batch"), "ftrl-rows")
    st = materialize(state if state is not None else zero_state(long, classes), "ftrl-state")
    best, best_state, since, history, done = None, st, 0, [], 0
    for _ in range(epochs):
        for b in range(count + 1):
            st = step(rows.filter(F.col("batch") == b), lab.filter(F.col("batch") == b), st, prm, classes, weight)
            done += 1
            if done % checkpoint_every == 0:
                st = materialize(st, "ftrl-state")
        st = materialize(st, "ftrl-state")
        if valid_long is None:
            best_state = st
            continue
        p = probabilities(valid_long, st, classes).join(valid_labels.select("id", "y"), "id")
        acc = p.agg(F.avg((F.col("cls") == F.col("y")).cast("double"))).first()[0] or 0.0
        history.append(float(acc))
        if best is None or acc > best:
            best, best_state, since = acc, st, 0
        else:
            since += 1
            if early_stop_rounds and since >= early_stop_rounds:
                break
    return best_state, history
