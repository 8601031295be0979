"""Learners on ``pyspark.ml``.

The fits are distributed ``pyspark.ml`` estimators; the glue here only maps
the reference's hyper-parameters to Spark's (see SURVEY V5/V6/V15/V16), adds
the ordinal reductions, and turns model outputs back into DataFrames.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import c
from ordlab.session import dealt


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def _label_stats(df: DataFrame, label: str):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return int(r["n"]), float(r["sd"] or 0.0)


def ridge(df: DataFrame, features, label: str, alpha: float, normalize: bool = True):
    """Ridge as the reference states it.  ``normalize=True`` maps
    ``alpha`` to ``regParam = alpha * std_pop(y)`` with standardization (V5);
    ``normalize=False`` to ``regParam = alpha / n * std_pop(y)`` without (V15)."""
    from pyspark.ml.regression import LinearRegression
    n, sd = _label_stats(df, label)
    reg = alpha * sd if normalize else alpha / n * sd
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0,
                          standardization=normalize, solver="normal")
    return lr.fit(assemble(df, features))


def lasso(df: DataFrame, features, label: str, alpha: float):
    """Normalised lasso, ``regParam = alpha * sqrt(n)`` with L1 (V6)."""
    from pyspark.ml.regression import LinearRegression
    n, _ = _label_stats(df, label)
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=alpha * math.sqrt(n),
                          elasticNetParam=1.0, standardization=True, solver="normal")
    return lr.fit(assemble(df, features))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Inverse class frequency with mean 1: ``w_c = n / (K n_c)``."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    from ordlab.operators.frame import attach
    tot = cnt.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = attach(cnt, tot).select(label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return df.join(F.broadcast(w), label)  # one row per class


def logistic_balanced(df: DataFrame, features, label: str, C: float = 1.0):
    """Class-balanced logistic regression, ``regParam = 1 / (C * sum w)``."""
    from pyspark.ml.classification import LogisticRegression
    d = balanced_weights(df, label)
    sw = d.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight",
                            regParam=1.0 / (C * sw), elasticNetParam=0.0, standardization=False)
    return lr.fit(assemble(d, features))


def poisson_glm(df: DataFrame, features, label: str, reg: float = 0.0):
    """L3: Poisson regression with log link (label must be >= 0)."""
    from pyspark.ml.regression import GeneralizedLinearRegression
    glm = GeneralizedLinearRegression(featuresCol="features", labelCol=label, family="poisson", link="log",
                                      regParam=reg, maxIter=50)
    return glm.fit(assemble(df, features))


def linear_booster(df: DataFrame, features, label: str, reg: float, l1_ratio: float):
    """L4: regularised linear model (elastic net)."""
    from pyspark.ml.regression import LinearRegression
    return LinearRegression(featuresCol="features", labelCol=label, regParam=reg,
                            elasticNetParam=l1_ratio).fit(assemble(df, features))


def huber_linear(df: DataFrame, features, label: str, epsilon: float = 1.35, reg: float = 0.0):
    """L10 robust form: ``LinearRegression(loss='huber')``."""
    from pyspark.ml.regression import LinearRegression
    return LinearRegression(featuresCol="features", labelCol=label, loss="huber", epsilon=epsilon,
                            regParam=reg).fit(assemble(df, features))


def forest(df: DataFrame, features, label: str, trees: int = 300, feature_fraction: float = 0.28,
           depth: int = 8, bootstrap: bool = True, seed: int = 1):
    """Random forest (``bootstrap=False`` is the extra-trees
    approximation: whole sample per tree, no random thresholds)."""
    from pyspark.ml.regression import RandomForestRegressor
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees,
                               featureSubsetStrategy=str(feature_fraction), maxDepth=depth,
                               bootstrap=bootstrap, seed=seed)
    return rf.fit(assemble(df, features))


def gbt_early_stop(df: DataFrame, features, label: str, is_valid: str, max_iter: int = 100,
                   step: float = 0.1, depth: int = 4, subsample: float = 1.0, seed: int = 1):
    """L1/L2: boosted trees with a holdout; the best round on the holdout
    (``evaluateEachIteration``) is reused to refit on all rows."""
    from pyspark.ml.regression import GBTRegressor
    d = assemble(df, features)
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, stepSize=step,
                       maxDepth=depth, subsamplingRate=subsample, seed=seed)
    m = gbt.fit(d.filter(~F.col(is_valid)))
    errs = m.evaluateEachIteration(d.filter(F.col(is_valid)), "squared")
    best = int(min(range(len(errs)), key=lambda i: errs[i])) + 1
    final = gbt.copy().setMaxIter(best).fit(d)
    return final, best, errs


def leaf_linear(df: DataFrame, features, label: str, trees: int = 20, depth: int = 3, alpha: float = 1.0,
                seed: int = 1):
    """Boosted trees -> one-hot of every tree's leaf -> ridge."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    d = assemble(df, features)
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth,
                       leafCol="leaf", seed=seed).fit(d)
    leaves = gbt.transform(d).drop("prediction").withColumn(
        "leaf_tokens", F.transform(vector_to_array("leaf"), lambda x, i: F.concat(
            F.lit("t"), i.cast("string"), F.lit("_"), x.cast("int").cast("string"))))
    cv = CountVectorizer(inputCol="leaf_tokens", outputCol="leaf_vec", binary=True, minDF=1.0).fit(leaves)
    enc = cv.transform(leaves)
    n, sd = _label_stats(df, label)
    lr = LinearRegression(featuresCol="leaf_vec", labelCol=label, regParam=alpha / n * sd,
                          elasticNetParam=0.0, standardization=False).fit(enc)
    return gbt, cv, lr


def class_probabilities(df: DataFrame, features, label: str, kind: str = "rf", n_classes: int = 8, seed: int = 1,
                        reg: float = 0.01):
    """Class-probability models; ``label`` in 1..K is shifted to 0..K-1
    inside.  ``reg`` is the penalty of ``softmax``.  Rows are dealt before the fit, which
    keeps each task's rows.  Returns the fitted pipeline model."""
    from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                           OneVsRest, RandomForestClassifier)
    d = dealt(df.withColumn("__lbl", (c(label) - 1).cast("double")))
    if kind == "rf":
        est = RandomForestClassifier(featuresCol="features", labelCol="__lbl", numTrees=50, maxDepth=6, seed=seed)
    elif kind == "softmax":
        est = LogisticRegression(featuresCol="features", labelCol="__lbl", family="multinomial", regParam=reg)
    elif kind == "tree":
        est = DecisionTreeClassifier(featuresCol="features", labelCol="__lbl", maxDepth=6, seed=seed)
    elif kind == "gbt_ovr":
        est = OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=3, seed=seed),
                        featuresCol="features", labelCol="__lbl")
    else:
        raise ValueError(kind)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features",
                                            handleInvalid="keep"), est]).fit(d)


def with_probability(model, df: DataFrame, out: str) -> DataFrame:
    """Class probabilities of a fitted pipeline as an array column.  A
    one-vs-rest model has none of its own: each class's binary margins go
    through the logistic function and are normalised to sum 1."""
    extra = ("features", "rawPrediction", "probability", "prediction")
    cols = [F.col(x) for x in df.columns]
    ovr = model.stages[-1]
    if not hasattr(ovr, "models"):
        return model.transform(df).select(*cols, vector_to_array("probability").alias(out))
    cur = model.stages[0].transform(df)
    each = []
    for k, m in enumerate(ovr.models):
        cur = m.transform(cur).withColumn(f"__c{k}", vector_to_array("probability")[1]).drop(*extra[1:])
        each.append(F.col(f"__c{k}"))
    total = each[0]
    for e in each[1:]:
        total = total + e
    share = [F.when(total > 0, e / total).otherwise(F.lit(1.0 / len(each))) for e in each]
    return cur.select(*cols, F.array(*share).alias(out))


def stack_probabilities(models, df: DataFrame, n_classes: int = 8, prefix: str = "stack_p") -> DataFrame:
    """Mean class probability of several fitted probability models
    (pipelines from ``class_probabilities``), added as K columns."""
    cur, names = df, []
    for i, m in enumerate(models):
        cur = with_probability(m, cur, f"__p{i}")
        names.append(f"__p{i}")
    mean = F.col(names[0])
    for a in names[1:]:
        mean = F.zip_with(mean, F.col(a), lambda x, y: x + y)
    mean = F.transform(mean, lambda x: x / F.lit(float(len(names))))
    return cur.select(*[x for x in cur.columns if x not in names],
                      *[mean[k].alias(f"{prefix}{k + 1}") for k in range(n_classes)])


def pairwise_rank(df: DataFrame, features, label: str, id_col: str, reg: float = 0.01, seed: int = 1):
    """Pairwise ranking with one sampled partner per row (as a pairwise
    booster samples pairs): rows are put in a seeded hash order, each row is
    paired with its successor (equi-join on position), pairs with equal labels
    are dropped, and a logistic model without intercept learns
    ``[y_i > y_j]`` from ``x_i - x_j``.  Linear in the row count."""
    from pyspark.ml.classification import LogisticRegression
    from ordlab.operators.rank import position
    h = df.withColumn("__h", F.xxhash64(c(id_col), F.lit(seed)))
    p = position(h, ["__h", id_col], "__pos")
    a = p.select(*[F.col(f).alias(f"a_{f}") for f in features], F.col(label).alias("a_y"), "__pos")
    b = p.select(*[F.col(f).alias(f"b_{f}") for f in features], F.col(label).alias("b_y"),
                 (F.col("__pos") - 1).alias("__pos"))
    pairs = a.join(b, "__pos").filter(F.col("a_y") != F.col("b_y"))
    diff = pairs.select(*[(F.col(f"a_{f}") - F.col(f"b_{f}")).alias(f) for f in features],
                        (F.col("a_y") > F.col("b_y")).cast("double").alias("__pl"))
    lr = LogisticRegression(featuresCol="features", labelCol="__pl", fitIntercept=False, regParam=reg,
                            standardization=True)
    return lr.fit(assemble(diff, features))


def linear_score(coefficients, features) -> "F.Column":
    """``w . x`` as a JVM expression (coefficients are model-sized)."""
    expr = F.lit(0.0)
    for w, f in zip(list(coefficients), features):
        expr = expr + F.lit(float(w)) * F.col(f)
    return expr


def ebc_fit(df: DataFrame, features, label: str, n_classes: int = 8, reg: float = 0.01,
            cost: str = "reference"):
    """Extended-binary reduction: every row is repeated for thresholds
    k = 1..K-1 with the threshold one-hot appended, label ``[y > k]`` and the
    G1 cost as weight; one weighted logistic model learns all thresholds.  The rows
    are dealt first: the fit keeps each task's repeated rows and reads them again in
    every iteration."""
    from pyspark.ml.classification import LogisticRegression
    d = ebc_expand(dealt(df), features, label, n_classes, cost)
    cols = list(features) + [f"__t{k}" for k in range(1, n_classes)]
    lr = LogisticRegression(featuresCol="features", labelCol="__b", weightCol="__w", regParam=reg)
    return lr.fit(assemble(d, cols)), cols


def ebc_expand(df: DataFrame, features, label: str, n_classes: int = 8, cost: str = "reference",
               with_label: bool = True) -> DataFrame:
    k = F.explode(F.sequence(F.lit(1), F.lit(n_classes - 1))).alias("__k")
    d = df.select("*", k)
    kk = F.col("__k").cast("double")
    onehot = [F.when(F.col("__k") == j, 1.0).otherwise(0.0).alias(f"__t{j}") for j in range(1, n_classes)]
    d = d.select("*", *onehot)
    if with_label:
        y = c(label).cast("double")
        B = F.when(y > kk, 1.0).otherwise(-1.0)
        base = B if cost == "reference" else y
        w = F.abs((base - kk) ** 2 - (base - kk - 1) ** 2)
        d = d.withColumn("__b", F.when(y > kk, 1.0).otherwise(0.0)).withColumn("__w", w)
    return d


def ebc_predict(model, cols, df: DataFrame, id_col: str, features, n_classes: int = 8, hard: bool = False):
    """D5 over the G6 model: ``1 + sum_k P(y > k)`` per row (or hard counts)."""
    from ordlab.operators.decode import decode_ebc
    d = ebc_expand(df.select(id_col, *features), features, None, n_classes, with_label=False)
    p = model.transform(assemble(d, cols)).select(id_col, "__k", vector_to_array("probability")[1].alias("__p"))
    agg = p.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("__k", "__p"))).alias("__a"))
    probs = F.transform("__a", lambda s: s["__p"])
    if hard:
        return agg.select(id_col, decode_ebc(F.transform(probs, lambda x: x - 0.5), hard=True,
                                             n_thresholds=n_classes - 1).alias("score"))
    return agg.select(id_col, decode_ebc(probs, n_thresholds=n_classes - 1).alias("score"))


def cocr_fit(df: DataFrame, features, label: str, n_classes: int = 8, reg: float = 0.01):
    """One weighted regression per k = 1..K on ``b = [y >= k]`` with the G2
    cost as weight.  Returns the K fitted models."""
    from pyspark.ml.regression import LinearRegression
    d = assemble(df, features)
    y = c(label).cast("double")
    models = []
    for k in range(1, n_classes + 1):
        dk = d.withColumn("__b", F.when(y >= k, 1.0).otherwise(0.0)) \
              .withColumn("__w", F.abs((y - k) ** 2 - (y - k + 1) ** 2))
        dk = dk.filter(F.col("__w") > 0)
        models.append(LinearRegression(featuresCol="features", labelCol="__b", weightCol="__w",
                                       regParam=reg).fit(dk))
    return models


def cocr_predict(models, df: DataFrame, id_col: str, features):
    """D6 over the G7 models: ``1 + sum_k f_k(x)``."""
    s = F.lit(1.0)
    for m in models:
        s = s + (linear_score(m.coefficients, features) + F.lit(float(m.intercept)))
    return df.select(id_col, s.alias("score"))


def importance_table(model, features) -> "list[tuple[str, float]]":
    """Feature importances as ``(feature, value)`` rows (feature-count sized)."""
    imp = model.featureImportances.toArray().tolist()
    return [(f, float(v)) for f, v in zip(features, imp)]


class KappaEvaluator(Evaluator, Params):
    """M14/UD2: QWK of a decoded prediction as a ``pyspark.ml`` Evaluator
    (larger is better), usable by ``CrossValidator``.  Decoding by fixed cut
    points (D2) or by rounding (D7)."""

    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column",
                          typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", typeConverter=TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "cut points (empty: round decode)",
                 typeConverter=TypeConverters.toListFloat)

    def __init__(self, predictionCol="prediction", labelCol="label", cuts=None):
        super().__init__()
        self._setDefault(predictionCol="prediction", labelCol="label", cuts=[])
        self._set(predictionCol=predictionCol, labelCol=labelCol, cuts=list(cuts or []))

    def _evaluate(self, dataset):
        from ordlab.operators.decode import decode_cut, decode_round
        from ordlab.operators.metrics import qwk
        p, y, cuts = self.getOrDefault("predictionCol"), self.getOrDefault("labelCol"), self.getOrDefault("cuts")
        cls = decode_cut(p, cuts) if cuts else decode_round(p)
        k = qwk(dataset.select(F.col(y).alias("__y"), cls.alias("__c")), "__y", "__c").first()[0]
        return float(k) if k is not None else float("nan")

    def isLargerBetter(self):
        return True


def softkappa_linear_fit(df: DataFrame, features, label: str, n_classes: int = 8, iters: int = 20,
                         lr: float = 1.0, l2: float = 1e-3):
    """A linear K-output model trained by gradient steps on the soft-kappa
    objective (G3).

    The standardised rows are pinned once; every iteration is one job in which
    each task turns its Arrow batches into numpy, computes the G3 gradient of
    its rows for the current coefficients and emits the partial sums
    ``sum g_k x_f`` and ``sum g_k`` (K x (d+1) numbers); one aggregate adds
    them up.  M and E depend only on the labels and are computed once.  The
    coefficient matrix is model-sized and stays on the driver, like the
    gradient solvers of ``pyspark.ml``.  Returns ``(W, b, means, stds, history)``."""
    import numpy as np
    from ordlab.session import materialize
    feats = list(features)
    K, d = n_classes, len(feats)
    mom = df.agg(*[F.avg(f).alias(f"m_{f}") for f in feats], *[F.stddev_pop(f).alias(f"s_{f}") for f in feats],
                 F.count(F.lit(1)).alias("n"), F.sum(c(label).cast("double")).alias("sy"),
                 F.sum(c(label).cast("double") * c(label).cast("double")).alias("syy")).first()
    mu = np.array([mom[f"m_{f}"] for f in feats], float)
    sd = np.array([mom[f"s_{f}"] or 1.0 for f in feats], float)
    M = float(mom["n"])
    E = 2.0 * (M * mom["syy"] - mom["sy"] ** 2)
    zcols = [f"z{i}" for i in range(d)]
    z = materialize(df.select(c(label).cast("double").alias("y"),
                              *[((F.col(f) - F.lit(float(mu[i]))) / F.lit(float(sd[i]))).alias(zcols[i])
                                for i, f in enumerate(feats)]), "softkappa-rows")
    cls = np.arange(1, K + 1, dtype=float)
    out_cols = [f"g{j}" for j in range(K * (d + 1))]
    schema = ", ".join(f"{col} double" for col in out_cols)
    W, b = np.zeros((K, d)), np.zeros(K)
    history = []
    for _ in range(iters):
        Wc, bc = W.copy(), b.copy()

        def partial_grads(batches, Wc=Wc, bc=bc):
            import pandas as pd
            acc = np.zeros(K * (d + 1))
            for pdf in batches:
                Z = pdf[zcols].to_numpy(dtype=float)
                y = pdf["y"].to_numpy(dtype=float)
                S = Z @ Wc.T + bc
                S -= S.max(axis=1, keepdims=True)
                P = np.exp(S)
                P /= P.sum(axis=1, keepdims=True)
                cost = (y[:, None] - cls[None, :]) ** 2
                m = (cost * P).sum(axis=1, keepdims=True)
                G = M * P * (cost - m) / E                      # G3 gradient per row and class
                acc[: K * d] += (G.T @ Z).ravel()
                acc[K * d:] += G.sum(axis=0)
            yield pd.DataFrame([acc], columns=out_cols)

        r = z.mapInPandas(partial_grads, schema).agg(*[F.sum(col).alias(col) for col in out_cols]).first()
        g = np.array([r[col] for col in out_cols], float)
        GW, Gb = g[: K * d].reshape(K, d), g[K * d:]
        W -= lr * (GW + l2 * W)
        b -= lr * Gb
        history.append(float(np.abs(GW).sum() + np.abs(Gb).sum()))
    return W, b, mu, sd, history


def softkappa_linear_predict(df: DataFrame, features, W, b, mu, sd, out: str = "prediction") -> DataFrame:
    """Expected class ``sum_k k softmax(s)_k`` of the L7 model."""
    from ordlab.functions.scalar import expected_class, softmax
    feats = list(features)
    K, d = W.shape
    z = [(F.col(f) - F.lit(float(mu[i]))) / F.lit(float(sd[i])) for i, f in enumerate(feats)]
    s = F.array(*[sum((F.lit(float(W[k, i])) * z[i] for i in range(d)), F.lit(float(b[k]))) for k in range(K)])
    # scores, probabilities and the expected class as separate columns, each
    # referring to the previous one by name (keeps the expression trees small)
    return (df.withColumn("__sk", s).withColumn("__pk", softmax("__sk", K))
              .withColumn(out, expected_class("__pk")).drop("__sk", "__pk"))
