"""Learner queries whose fit has a closed form.

Each model is fitted by the library's learner on the train rows of a label that the
features explain; the SQL solves the same problem directly: normal equations for the
linear models, shares and means by group where the model is saturated, and the best
of all splits for a stump.  Iterative fits are rounded to what their tolerance gives.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import models as md
from ordlab.plans.boosting import SQL_EXPLAINED, explained
from ordlab.plans.catalog import query

PAIR = ["f_size", "f_brand"]
RIDGE_ALPHA, PLAIN_ALPHA, LASSO_ALPHA = 0.5, 2500.0, 2e-3


def _train(spark, sf):
    d = explained(spark, sf).filter(~F.col("test"))
    return d.withColumn("yd", F.col("y").cast("double")).withColumn("large", (F.col("f_size") > 25).cast("double"))


SQL_TRAIN = f"""select *, cast(y as double) yd, case when f_size > 25 then 1e0 else 0e0 end large
from ({SQL_EXPLAINED}) where not test"""

SQL_MOMENTS = f"""select count(*) * 1e0 n, avg(f_size) m1, avg(f_brand) m2, avg(yd) my, var_pop(f_size) v1, var_pop(f_brand) v2,
  covar_pop(f_size, f_brand) c12, covar_pop(f_size, yd) c1, covar_pop(f_brand, yd) c2 from ({SQL_TRAIN})"""

SQL_RIDGE = f"""with m as ({SQL_MOMENTS}),
a as (select 'ridge_norm' model, m.*, v1 * (1 + {RIDGE_ALPHA}e0) a1, v2 * (1 + {RIDGE_ALPHA}e0) a2 from m
      union all select 'ridge_plain', m.*, v1 + {PLAIN_ALPHA}e0 / n, v2 + {PLAIN_ALPHA}e0 / n from m),
b as (select model, m1, m2, my, (c1 * a2 - c12 * c2) / (a1 * a2 - c12 * c12) b1, (c2 * a1 - c12 * c1) / (a1 * a2 - c12 * c12) b2 from a)
select model, round(b1, 6) coef_size, round(b2, 6) coef_brand, round(my - b1 * m1 - b2 * m2, 6) intercept from b"""


@query("ridge_normal_equations", SQL_RIDGE)
def q_ridge_normal_equations(spark, sf):
    """Coefficients of both ridge forms, by two normal equations."""
    tr = _train(spark, sf)
    fits = [("ridge_norm", md.ridge(tr, PAIR, "yd", RIDGE_ALPHA)), ("ridge_plain", md.ridge(tr, PAIR, "yd", PLAIN_ALPHA, normalize=False))]
    rows = [(name, *[round(float(v), 6) for v in (*m.coefficients, m.intercept)]) for name, m in fits]
    return spark.createDataFrame(rows, "model string, coef_size double, coef_brand double, intercept double")


# all nine sign patterns: the consistent one of the least objective is the solution
SQL_LASSO = f"""with m as ({SQL_MOMENTS}),
a as (select *, {LASSO_ALPHA} * sqrt(n) * sqrt(v1) l1, {LASSO_ALPHA} * sqrt(n) * sqrt(v2) l2 from m),
k as (select a.*, s1, s2, c1 - l1 * s1 d1, c2 - l2 * s2 d2
      from a, (select unnest([-1e0, 0e0, 1e0]) s1), (select unnest([-1e0, 0e0, 1e0]) s2)),
b as (select *, case when s1 = 0 then 0e0 when s2 = 0 then d1 / v1 else (d1 * v2 - c12 * d2) / (v1 * v2 - c12 * c12) end b1,
                case when s2 = 0 then 0e0 when s1 = 0 then d2 / v2 else (d2 * v1 - c12 * d1) / (v1 * v2 - c12 * c12) end b2 from k),
best as (select * from b where b1 * s1 >= 0 and b2 * s2 >= 0
         order by v1 * b1 * b1 / 2 + c12 * b1 * b2 + v2 * b2 * b2 / 2 - c1 * b1 - c2 * b2 + l1 * abs(b1) + l2 * abs(b2) limit 1)
select 'lasso' model, round(b1, 4) coef_size, round(b2, 4) coef_brand, round(my - b1 * m1 - b2 * m2, 4) intercept from best"""


@query("lasso_normal_equations", SQL_LASSO)
def q_lasso_normal_equations(spark, sf):
    """Coefficients of the normalised lasso of two features."""
    m = md.lasso(_train(spark, sf), PAIR, "yd", LASSO_ALPHA)
    return spark.createDataFrame([("lasso", *[round(float(v), 4) for v in (*m.coefficients, m.intercept)])],
                                 "model string, coef_size double, coef_brand double, intercept double")


SQL_POISSON = f"""with g as (select avg(yd) filter (large = 0) m0, avg(yd) filter (large = 1) m1 from ({SQL_TRAIN}))
select 'poisson' model, round(ln(m1 / m0), 5) coef_large, round(ln(m0), 5) intercept from g"""


@query("poisson_saturated", SQL_POISSON)
def q_poisson_saturated(spark, sf):
    """L3: the log-link fit on one indicator gives the logarithms of the group means."""
    m = md.poisson_glm(_train(spark, sf), ["large"], "yd")
    return spark.createDataFrame([("poisson", round(float(m.coefficients[0]), 5), round(float(m.intercept), 5))],
                                 "model string, coef_large double, intercept double")


SQL_LOGISTIC = f"""with t as (select case when y > 4 then 1 else 0 end hi, large from ({SQL_TRAIN})),
c as (select sum(hi) * 1e0 n1, sum(1 - hi) * 1e0 n0 from t),
g as (select large, sum(hi) * 1e0 k1, sum(1 - hi) * 1e0 k0 from t group by large)
select large, round(k1 / n1 / (k1 / n1 + k0 / n0), 3) p from g, c"""


@query("logistic_saturated", SQL_LOGISTIC)
def q_logistic_saturated(spark, sf):
    """The balanced logistic fit on one indicator gives the balanced shares of the groups."""
    from pyspark.ml.functions import vector_to_array
    tr = _train(spark, sf).withColumn("hi", (F.col("y") > 4).cast("double"))
    m = md.logistic_balanced(tr, ["large"], "hi", C=1e9)
    p = m.transform(md.assemble(tr.select("large").distinct(), ["large"]))
    return p.select("large", F.round(vector_to_array("probability")[1], 3).alias("p"))


SQL_STUMP = f"""with b as (select f_brand v, sum(yd) s, sum(yd * yd) q, count(*) * 1e0 n from ({SQL_TRAIN}) group by v),
t as (select v, sum(s) over w sl, sum(n) over w nl, sum(s) over () s, sum(n) over () n from b window w as (order by v)),
best as (select v cut, sl / nl low, (s - sl) / (n - nl) high from t where n > nl
         order by sl * sl / nl + (s - sl) * (s - sl) / (n - nl) desc, v limit 1)
select b.v f_brand, cast(b.n as bigint) n, round(case when b.v <= cut then low else high end, 6) prediction from b, best"""


@query("forest_stump", SQL_STUMP)
def q_forest_stump(spark, sf):
    """A forest of one stump without resampling takes the best of all splits of the brand."""
    tr = _train(spark, sf)
    m = md.forest(tr, ["f_brand"], "yd", trees=1, feature_fraction=1.0, depth=1, bootstrap=False)
    levels = tr.groupBy("f_brand").agg(F.count(F.lit(1)).alias("n"))
    return m.transform(md.assemble(levels, ["f_brand"])).select("f_brand", "n", round6("prediction").alias("prediction"))


SQL_SHARES = f"""with g as (select large, sum(case when y > 4 then 1e0 else 0e0 end) k2, sum(case when y between 3 and 4 then 1e0 else 0e0 end) k1,
  sum(case when y < 3 then 1e0 else 0e0 end) k0, count(*) n from ({SQL_TRAIN}) group by large)
select large, round(k0 / n, 2) p1, round(k1 / n, 2) p2, round(k2 / n, 2) p3 from g"""


@query("softmax_saturated", SQL_SHARES)
def q_softmax_saturated(spark, sf):
    """The multinomial fit on one indicator gives the class shares of the groups."""
    from pyspark.ml.functions import vector_to_array
    tr = _train(spark, sf).withColumn("band", F.when(F.col("y") > 4, 3).when(F.col("y") >= 3, 2).otherwise(1))
    m = md.class_probabilities(tr, ["large"], "band", "softmax", reg=0.0)
    p = vector_to_array("probability")
    return m.transform(tr.select("large").distinct()).select("large", *[F.round(p[k - 1], 2).alias(f"p{k}") for k in (1, 2, 3)])
