"""Per-row gradient / hessian tables of the ordinal objectives.

Input: one row per example with a label ``y`` in 1..K, an array of K raw
class scores ``s`` and an optional weight.  Output: one row per (example,
class) with ``grad`` and ``hess`` — the long form a Spark learner aggregates
by feature.  Global terms (row count, label moments, mean |hessian|) are
scalar subqueries over one-row aggregates; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import c


def _explode_k(df: DataFrame, id_col: str, y: str, s: str, weight, n_classes: int) -> DataFrame:
    w = c(weight).cast("double") if weight is not None else F.lit(1.0)
    return df.select(c(id_col).alias("id"), c(y).cast("double").alias("__y"), w.alias("__v"),
                     F.posexplode(c(s)).alias("__k0", "__s")).withColumn("k", F.col("__k0") + 1)


def ebc(df: DataFrame, id_col: str, y: str, s: str, weight=None, n_classes: int = 8,
        cost: str = "reference") -> DataFrame:
    """G1: extended-binary objective over thresholds k=1..K-1; the K-th
    output gets zero gradient and hessian.  ``cost='reference'`` uses the
    +-1 target in the cost (Q3), ``cost='label'`` the class label."""
    d = _explode_k(df, id_col, y, s, weight, n_classes)
    k = F.col("k").cast("double")
    B = F.when(F.col("__y") > k, 1.0).otherwise(-1.0)
    base = B if cost == "reference" else F.col("__y")
    w = F.abs((base - k) ** 2 - (base - k - 1) ** 2)
    t = F.exp(B * F.col("__s"))
    active = F.col("k") < n_classes
    g = F.when(active, -F.col("__v") * w * B / (F.lit(1.0) + t)).otherwise(0.0)
    h = F.when(active, F.col("__v") * w * B * B * t / ((F.lit(1.0) + t) ** 2)).otherwise(0.0)
    return d.select("id", "k", g.alias("grad"), h.alias("hess"))


def cocr(df: DataFrame, id_col: str, y: str, s: str, weight=None, n_classes: int = 8) -> DataFrame:
    """Cost-sensitive ordinal classification by regression, k=1..K:
    ``b=[y>=k]``, ``w=|(y-k)^2-(y-k+1)^2|``, ``g=2vw(s_k-b)``, ``h=2vw``."""
    d = _explode_k(df, id_col, y, s, weight, n_classes)
    k = F.col("k").cast("double")
    b = F.when(F.col("__y") >= k, 1.0).otherwise(0.0)
    w = F.abs((F.col("__y") - k) ** 2 - (F.col("__y") - k + 1) ** 2)
    g = F.lit(2.0) * F.col("__v") * w * (F.col("__s") - b)
    h = F.lit(2.0) * F.col("__v") * w
    return d.select("id", "k", g.alias("grad"), h.alias("hess"))


def _softmax_cols(df: DataFrame, id_col, y, s, weight, K, keep=()):
    """Rows with ``id, keep.., __y, __v, __p0..__p{K-1}`` (softmax unrolled)."""
    w = c(weight).cast("double") if weight is not None else F.lit(1.0)
    keep = list(keep)
    base = df.select(c(id_col).alias("id"), *keep, c(y).cast("double").alias("__y"), w.alias("__v"),
                     *[c(s)[k].cast("double").alias(f"__s{k}") for k in range(K)])
    mx = F.greatest(*[F.col(f"__s{k}") for k in range(K)])
    base = base.select("id", *keep, "__y", "__v", *[F.exp(F.col(f"__s{k}") - mx).alias(f"__e{k}") for k in range(K)])
    se = F.col("__e0")
    for k in range(1, K):
        se = se + F.col(f"__e{k}")
    return base.select("id", *keep, "__y", "__v", *[(F.col(f"__e{k}") / se).alias(f"__p{k}") for k in range(K)])


def _d2(k):
    """``(y - class)^2`` for the class of column k (classes numbered from 1)."""
    yv = F.col("__y")
    return (yv - F.lit(float(k + 1))) * (yv - F.lit(float(k + 1)))


def _expected_cost(K):
    m = _d2(0) * F.col("__p0")
    for k in range(1, K):
        m = m + _d2(k) * F.col(f"__p{k}")
    return m


def softkappa_wide(df: DataFrame, id_col: str, y: str, s: str, weight=None, n_classes: int = 8,
                   keep=()) -> DataFrame:
    """G3 in wide form: ``id, keep.., __v, __g0.., __q0..`` (gradient and raw
    second derivative per class), for learners that aggregate by feature."""
    from ordlab.operators.frame import attach
    K = n_classes
    base = _softmax_cols(df, id_col, y, s, weight, K, keep)
    glob = base.agg(F.count(F.lit(1)).cast("double").alias("__rows"),
                    (F.lit(2.0) * (F.count(F.lit(1)) * F.sum(F.col("__y") * F.col("__y"))
                                   - F.sum("__y") * F.sum("__y"))).alias("__E"))
    rows = attach(base, glob).withColumn("__m", _expected_cost(K))
    M, E = F.col("__rows"), F.col("__E")
    g = {k: F.col("__v") * M * (F.col(f"__p{k}") * (_d2(k) - F.col("__m"))) / E for k in range(K)}
    q = {k: M * F.col(f"__p{k}") * (F.lit(1.0) - F.lit(2.0) * F.col(f"__p{k}")) * (_d2(k) - F.col("__m")) / E
         for k in range(K)}
    return rows.select("id", *list(keep), "__v", *[g[k].alias(f"__g{k}") for k in range(K)],
                       *[q[k].alias(f"__q{k}") for k in range(K)])


def _long_with_scaled_hess(wide: DataFrame, K: int, hess_scale: float, weighted: bool = True) -> DataFrame:
    from ordlab.operators.frame import scalar
    sq = F.abs(F.col("__q0"))
    for k in range(1, K):
        sq = sq + F.abs(F.col(f"__q{k}"))
    mq = scalar(wide.agg((F.avg(sq) / F.lit(float(K))).alias("__mq")), "__mq")
    long = wide.select("id", "__v", F.explode(F.array(*[
        F.struct(F.lit(k + 1).alias("k"), F.col(f"__g{k}").alias("grad"), F.col(f"__q{k}").alias("q"))
        for k in range(K)])).alias("__x"))
    v = F.col("__v") if weighted else F.lit(1.0)
    return long.select("id", F.col("__x.k").alias("k"), F.col("__x.grad").alias("grad"),
                       (v * F.abs("__x.q") * F.lit(hess_scale) / mq).alias("hess"))


def softkappa(df: DataFrame, id_col: str, y: str, s: str, weight=None, n_classes: int = 8,
              hess_scale: float = 0.000125) -> DataFrame:
    """Soft-kappa objective with the label histogram on both sides of E.

    ``p = softmax(s)``, ``m = sum_j (y-j)^2 p_j``, ``E = 2(M sum y^2 - (sum y)^2)``
    (the closed form of ``sum_ij (i-j)^2 h_i h_j``), ``g_n = v M p_n((y-n)^2-m)/E``,
    ``q_n = M p_n(1-2p_n)((y-n)^2-m)/E``, ``h_n = v |q_n| hess_scale / mean|q|``.

    The K class scores are unrolled into columns so every term is a plain
    codegen expression; M, E and mean|q| are scalar subqueries."""
    wide = softkappa_wide(df, id_col, y, s, weight, n_classes)
    return _long_with_scaled_hess(wide, n_classes, hess_scale)


def softkappa_predicted_hist(df: DataFrame, id_col: str, y: str, s: str, n_classes: int = 8,
                             hess_scale: float = 0.000125) -> DataFrame:
    """The older soft-kappa form whose denominator uses the predicted
    class histogram ``hp_j = sum_rows p_j``, so E moves with the scores.

    With ``O = sum_rows m``, ``E = sum_ij (i-j)^2 h_i hp_j``,
    ``c_k = sum_l (k-l)^2 h_l``, ``dO_n = p_n((y-n)^2 - m)``,
    ``dE_n = p_n(c_n - sum_k p_k c_k)`` and the second derivatives with the
    extra factor ``(1 - 2 p_n)``: ``g = M (dO E - O dE) / E^2``,
    ``h = M ((d2O E - O d2E) E^2 - (dO E - O dE) 2 E dE) / E^4``, then scaled
    to mean ``hess_scale`` and made positive.  No sample weights (as the
    reference's older form)."""
    from ordlab.operators.frame import attach
    K = n_classes
    base = _softmax_cols(df, id_col, y, s, None, K).withColumn("__m", _expected_cost(K))
    aggs = [F.count(F.lit(1)).cast("double").alias("__rows"), F.sum("__m").alias("__O")]
    aggs += [F.sum(F.col(f"__p{j}")).alias(f"__hp{j}") for j in range(K)]
    aggs += [F.sum(F.when(F.col("__y") == F.lit(float(l + 1)), 1.0).otherwise(0.0)).alias(f"__h{l}")
             for l in range(K)]
    glob = base.agg(*aggs)
    E = None
    for i in range(K):
        for j in range(K):
            if i != j:
                t = F.lit(float((i - j) ** 2)) * F.col(f"__h{i}") * F.col(f"__hp{j}")
                E = t if E is None else E + t
    cs = []
    for k in range(K):
        ck = None
        for l in range(K):
            if k != l:
                t = F.lit(float((k - l) ** 2)) * F.col(f"__h{l}")
                ck = t if ck is None else ck + t
        cs.append(ck.alias(f"__c{k}"))
    glob = glob.select("__rows", "__O", E.alias("__E"), *cs)
    rows = attach(base, glob)
    pc = F.col("__p0") * F.col("__c0")
    for k in range(1, K):
        pc = pc + F.col(f"__p{k}") * F.col(f"__c{k}")
    rows = rows.withColumn("__pc", pc)
    M, O, Ev = F.col("__rows"), F.col("__O"), F.col("__E")
    g, q = {}, {}
    for n in range(K):
        p = F.col(f"__p{n}")
        dO = p * (_d2(n) - F.col("__m"))
        dE = p * (F.col(f"__c{n}") - F.col("__pc"))
        d2O = p * (F.lit(1.0) - F.lit(2.0) * p) * (_d2(n) - F.col("__m"))
        d2E = p * (F.lit(1.0) - F.lit(2.0) * p) * (F.col(f"__c{n}") - F.col("__pc"))
        g[n] = M * (dO * Ev - O * dE) / (Ev * Ev)
        q[n] = M * ((d2O * Ev - O * d2E) * Ev * Ev - (dO * Ev - O * dE) * F.lit(2.0) * Ev * dE) / (Ev ** 4)
    wide = rows.select("id", "__v", *[g[k].alias(f"__g{k}") for k in range(K)],
                       *[q[k].alias(f"__q{k}") for k in range(K)])
    return _long_with_scaled_hess(wide, K, hess_scale, weighted=False)


def pseudo_huber(df: DataFrame, id_col: str, y: str, pred: str, gamma: float = 0.9) -> DataFrame:
    """``d = p - y``, ``g = d / sqrt(gamma^2 + d^2)``, ``h = gamma^2 (gamma^2 + d^2)^-1.5``."""
    d = c(pred).cast("double") - c(y).cast("double")
    g2 = F.lit(gamma * gamma)
    return df.select(c(id_col).alias("id"), (d / F.sqrt(g2 + d * d)).alias("grad"),
                     (g2 * F.pow(g2 + d * d, F.lit(-1.5))).alias("hess"))


# UD2: objective name -> gradient/hessian table builder
REGISTRY = {"ebc": ebc, "cocr": cocr, "softkappa": softkappa, "softkappa_predicted_hist": softkappa_predicted_hist,
            "pseudo_huber": pseudo_huber}
