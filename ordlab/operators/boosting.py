"""Functional boosting on user objectives (L1, L2, L7, UD2, G1-G5).

A round asks the objective for its gradient table ``(id, k, grad, hess)`` at the
current scores, fits one stock weighted ``DecisionTreeRegressor`` to the Newton
targets ``-grad / hess`` with weights ``hess`` (a leaf's weighted mean is then
``-sum grad / sum hess``), and adds the tree's shrunken values to the scores.  The
output number k is a feature of the tree, so one fit serves all outputs.  Rows
and features can be sampled per round by seeded hashes.  A holdout flag, an
evaluation hook and a patience stop the rounds; the best round counts.

The row table (features, label, scores) is pinned once a round, so that every
fit and retry sees the same scores.  Trees live on the driver (a few numbers per
leaf) and are applied as column expressions, without Python and without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import c, uniform
from ordlab.operators import objectives as ob
from ordlab.session import materialize


def squared(df: DataFrame, id_col, y: str, s: str) -> DataFrame:
    """Squared loss: grad = s - y, hess = 1."""
    return df.select(c(id_col).alias("id"), F.lit(1).alias("k"), (F.col(s)[0] - F.col(y)).alias("grad"), F.lit(1.0).alias("hess"))


def pseudo_huber(df: DataFrame, id_col, y: str, s: str) -> DataFrame:
    """G5 on the one score."""
    return ob.pseudo_huber(df, id_col, y, F.col(s)[0]).withColumn("k", F.lit(1))


def softkappa(df: DataFrame, id_col, y: str, s: str) -> DataFrame:
    """G3 with a mean hessian of the size of the gradients, which fall with the row count."""
    g = ob.softkappa(df, id_col, y, s, hess_scale=1.0)
    n = df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    return g.withColumn("hess", F.col("hess") / n)


#: objective name -> (gradient table, number of outputs)
OBJECTIVES: dict[str, tuple[Callable, int]] = {
    "squared": (squared, 1), "pseudo_huber": (pseudo_huber, 1), "softkappa": (softkappa, 8), "ebc": (ob.ebc, 8), "cocr": (ob.cocr, 8)}


MISSING = 1e300


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    """Rows whose feature is at most ``threshold`` go left; missing values go right."""
    feature: str
    threshold: float
    left: Leaf | Split
    right: Leaf | Split


def tree_of(model, features: list[str], l2: float = 0.0, cap: float | None = None) -> Leaf | Split:
    """A fitted tree as plain nodes.  ``l2`` shrinks a leaf as ``G / (H + l2)``
    does, ``cap`` bounds its size."""
    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            h = float(node.impurityStats().count())
            v = float(node.prediction()) * (h / (h + l2) if h + l2 > 0 else 0.0)
            return Leaf(v if cap is None else max(-cap, min(cap, v)))
        s = node.split()
        return Split(features[s.featureIndex()], float(s.threshold()), walk(node.leftChild()), walk(node.rightChild()))

    return walk(model._java_obj.rootNode())


def tree_column(node: Leaf | Split, k: int) -> Column:
    """The tree's value of output ``k`` as a column expression (splits on k are resolved here)."""
    if isinstance(node, Leaf):
        return F.lit(node.value)
    if node.feature == "__k":
        return tree_column(node.left if k <= node.threshold else node.right, k)
    return F.when(F.col(node.feature).cast("double") <= F.lit(node.threshold), tree_column(node.left, k)).otherwise(tree_column(node.right, k))


@dataclass
class Boosted:
    """Fitted trees, shrinkage, start scores and the holdout value after each round."""
    features: list[str]
    outputs: int
    rate: float
    start: float
    trees: list = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    @property
    def best_round(self) -> int:
        """Rounds up to the least holdout value (all without a holdout)."""
        ok = [v for v in self.history if not math.isnan(v)]
        return self.history.index(min(ok)) + 1 if ok else len(self.trees)

    def score(self, df: DataFrame, out: str = "s", rounds: int | None = None, every: int = 10) -> DataFrame:
        """Add the array of raw scores; by default with the best number of rounds.
        The rows are pinned after every ``every`` trees: scores that are still
        expressions would be copied into each use of a decoder."""
        trees = self.trees[:self.best_round if rounds is None else rounds]
        cols = df.columns
        d = df.withColumn(out, F.array(*[F.lit(self.start)] * self.outputs))
        for a in range(0, len(trees), every):
            part = [sum((F.lit(self.rate) * tree_column(t, k) for t in trees[a:a + every]), F.col(out)[k - 1]) for k in range(1, self.outputs + 1)]
            d = materialize(d.withColumn(out, F.array(*part)), "scored")
        return d.select(*[x for x in cols if x != out], out)


def _known(x: str) -> Column:
    """A feature for the fit; what is missing lies above every number, so it goes right."""
    v = F.col(x).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(MISSING)).otherwise(v)


def boost(df: DataFrame, features, label: str, id_col: str, objective: str | Callable = "squared", n_outputs: int | None = None,
          rounds: int = 50, rate: float = 0.3, depth: int = 3, max_bins: int = 64, min_weight_share: float = 0.0,
          row_share: float = 1.0, feature_share: float = 1.0, start: float = 0.0, l2: float = 0.0, cap: float | None = None,
          hess_floor: float = 0.0, valid: str | None = None, hook: Callable[[DataFrame], float] | None = None,
          patience: int = 5, seed: int = 1) -> Boosted:
    """Boost ``objective`` (a name of ``OBJECTIVES`` or a function of ``(df, id_col,
    y, s)`` that returns ``(id, k, grad, hess)``, with ``n_outputs``).

    ``valid`` flags holdout rows, ``hook`` maps scored holdout rows (columns id, y,
    s) to a value that is better when smaller; rounds stop after ``patience`` rounds
    without a better one.  ``hess_floor`` raises small hessians to that share of the
    round's mean, so that no row gets a huge target.  Rows with a null label are left
    out; a missing feature goes right at each split."""
    grad, k_out = OBJECTIVES[objective] if isinstance(objective, str) else (objective, int(n_outputs or 1))
    features = list(features)
    model = Boosted(features, k_out, rate, start)
    state = df.filter(c(label).isNotNull()).select(
        c(id_col).alias("id"), *[_known(x).alias(x) for x in features], c(label).cast("double").alias("y"),
        (F.col(valid) if valid else F.lit(False)).alias("__valid"), F.array(*[F.lit(start)] * k_out).alias("s"))
    state = materialize(state, "boost")
    if state.filter(~F.col("__valid")).isEmpty():
        return model
    rng = np.random.default_rng(seed)
    for r in range(rounds):
        train = state.filter(~F.col("__valid"))
        # the id column carries the row's features, so the table needs no join
        g = grad(train, F.struct("id", *features), "y", "s")
        g = g.select("id.*", F.col("k").cast("double").alias("__k"), "grad", "hess")
        if row_share < 1.0:
            g = g.filter(uniform("id", seed * 100_003 + r) < row_share)
        if hess_floor > 0:
            floor = g.agg((F.avg("hess") * hess_floor).alias("f")).scalar()
            g = g.withColumn("hess", F.greatest("hess", floor))
        used = [x for x in features if feature_share >= 1.0 or rng.random() < feature_share] or features[:1]
        cols = used + (["__k"] if k_out > 1 else [])
        rows = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error").transform(
            # rows without a hessian weigh nothing; a filter on it would copy the objective's expressions
            g.withColumn("target", F.coalesce(F.try_divide(-F.col("grad"), F.col("hess")), F.lit(0.0))))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="target", weightCol="hess", maxDepth=depth, maxBins=max_bins,
                                     minWeightFractionPerNode=min_weight_share, seed=seed).fit(rows)
        nodes = tree_of(tree, cols, l2, cap)
        model.trees.append(nodes)
        step = [F.col("s")[k - 1] + F.lit(rate) * tree_column(nodes, k) for k in range(1, k_out + 1)]
        state = materialize(state.withColumn("s", F.array(*step)), "boost")
        if valid and hook:
            model.history.append(hook(state.filter("__valid")))
            if len(model.history) - model.best_round >= patience:
                break
    return model
