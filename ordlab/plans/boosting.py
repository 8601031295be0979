"""Boosting and evaluation-hook queries (L1, L2, L7, UD2, M14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import boosting as bo
from ordlab.operators import hooks as hk
from ordlab.operators import models as md
from ordlab.operators.metrics import qwk
from ordlab.operators.profile import class_cdf
from ordlab.operators.split import fold_table, split_key
from ordlab.plans.catalog import T, query
from ordlab.plans.standins import SQL_PART_SCORES, SQL_SPLIT_KEY, part_scores
from ordlab.session import dealt, materialize

FEATURES = ["f_size", "f_brand", "f_price", "f_name"]
# a label that the features explain, with an interaction and hashed noise
Y_EXPR = ("least(8, greatest(1, cast(floor(1 + p_size / 8e0 + case when p_size > 25 then (f_brand % 5) - 2 else 2 - (f_brand % 5) end"
          " + ({noise} - 5000) / 4e3) as int)))")


def explained(spark, sf):
    """Part rows: four features, a label 1..8 that depends on them, a train/test split."""
    p = T(spark, sf, "part").select("p_partkey", "p_size", F.expr("cast(substring(p_brand, 7) as int)").alias("f_brand"),
                                    F.col("p_retailprice").alias("f_price"), F.length("p_name").cast("double").alias("f_name"))
    p = p.withColumn("noise", split_key("p_partkey", F.lit(91)))
    d = p.select("p_partkey", F.expr(Y_EXPR.format(noise="noise")).alias("y"), F.col("p_size").cast("double").alias("f_size"),
                    F.col("f_brand").cast("double").alias("f_brand"), "f_price", "f_name",
                    (split_key("p_partkey", F.lit(92)) < 2000).alias("test"))
    return materialize(dealt(d, "p_partkey"), "explained")


SQL_EXPLAINED = f"""select p_partkey, {Y_EXPR.format(noise='noise')} y, cast(p_size as double) f_size, cast(f_brand as double) f_brand,
  f_price, f_name, {SQL_SPLIT_KEY.format(run="'92'", id='p_partkey')} < 2000 test
from (select p_partkey, p_size, cast(substr(p_brand, 7) as integer) f_brand, p_retailprice f_price, cast(length(p_name) as double) f_name,
             {SQL_SPLIT_KEY.format(run="'91'", id='p_partkey')} noise from part)"""

SQL_FIRST_ROUND = f"""with p as ({SQL_EXPLAINED}),
g as (select f_size, f_brand, -y / sqrt(8.1e-1 + y * y) g, 8.1e-1 * pow(8.1e-1 + y * y, -1.5e0) h from p where not test),
x as (select 'f_size' feature, f_size v, g, h from g union all select 'f_brand', f_brand, g, h from g),
b as (select feature, v, sum(g) g, sum(h) h from x group by all),
t as (select feature, (v + lead(v) over w) / 2 threshold, sum(g) over w gl, sum(h) over w hl,
             sum(g) over (partition by feature) g, sum(h) over (partition by feature) h from b
      window w as (partition by feature order by v)),
s as (select feature, threshold, gl, hl, g - gl gr, h - hl hr, gl * gl / hl + (g - gl) * (g - gl) / (h - hl) gain from t where threshold is not null)
select feature, round(threshold, 6) threshold, round(-gl / hl, 6) left_value, round(-gr / hr, 6) right_value
from s order by gain desc limit 1"""


@query("boost_first_round", SQL_FIRST_ROUND)
def q_boost_first_round(spark, sf):
    """L7/UD2: the first round of depth 1 on the pseudo-Huber objective: split and Newton leaf values."""
    d = explained(spark, sf).filter(~F.col("test"))
    t = bo.boost(d, ["f_size", "f_brand"], "y", "p_partkey", "pseudo_huber", rounds=1, depth=1).trees[0]
    return spark.createDataFrame([(t.feature, round(t.threshold, 6), round(t.left.value, 6), round(t.right.value, 6))],
                                 "feature string, threshold double, left_value double, right_value double")


@query("boost_softkappa")
def q_boost_softkappa(spark, sf):
    """Boosting on the soft-kappa and the cost-sensitive objective with a stop on a holdout of
    the train part, beside the linear soft-kappa model; kappas of the test rows by the hooks."""
    d = explained(spark, sf).withColumn("valid", split_key("p_partkey", F.lit(93)) < 2000)
    train, test = d.filter(~F.col("test")), d.filter(F.col("test"))
    cdf = class_cdf(train, "y")
    soft = bo.boost(train, FEATURES, "y", "p_partkey", "softkappa", rounds=8, rate=0.8, depth=6, hess_floor=1.0, valid="valid",
                    hook=hk.kappa_hook("softkappa", "y", "s", "id", cdf), patience=4)
    cost = bo.boost(train, FEATURES, "y", "p_partkey", "cocr", rounds=8, rate=0.5, depth=6, valid="valid",
                    hook=hk.kappa_hook("cocr", "y", "s", "id", cdf), patience=4)
    W, b, mu, sd, _ = md.softkappa_linear_fit(train, FEATURES, "y", iters=40, lr=1.0)
    lin = md.softkappa_linear_predict(test, FEATURES, W, b, mu, sd, out="e")
    rows = [("boosted_softkappa", soft.best_round, -hk.kappa_hook("softkappa", "y", "s", "p_partkey", cdf)(soft.score(test))),
            ("boosted_cocr", cost.best_round, -hk.kappa_hook("cocr", "y", "s", "p_partkey", cdf)(cost.score(test))),
            ("linear_softkappa", 40, -hk.kappa_hook("cdf", "y", "e", "p_partkey", cdf)(lin))]
    return spark.createDataFrame([(m, r, round(k, 6)) for m, r, k in rows], "model string, rounds int, kappa double")


SQL_PAIR_GRADIENT = f"""with p as (select p_partkey id, y, f_size / 1e1 + f_price / 1e3 s from ({SQL_EXPLAINED})),
g as (select a.id i, b.id j, -2e0 * greatest(1e0 - (a.s - b.s), 0e0) g from p a join p b on a.y > b.y)
select id, round(coalesce(gi, 0e0) - coalesce(gj, 0e0), 6) grad from p
left join (select i, sum(g) gi from g group by i) on i = id left join (select j, sum(g) gj from g group by j) on j = id"""


@query("pair_gradient", SQL_PAIR_GRADIENT)
def q_pair_gradient(spark, sf):
    """The squared-hinge gradient over all pairs of parts, without forming a pair."""
    from ordlab.operators.ranking import pair_gradient
    d = explained(spark, sf).withColumn("s", F.col("f_size") / 10 + F.col("f_price") / 1e3)
    return pair_gradient(d, "p_partkey", "y", "s").select("id", round6("grad").alias("grad"))


@query("pairwise_all")
def q_pairwise_all(spark, sf):
    """A linear score trained on all pairs; share of test rows above class 4 ranked above the others."""
    from ordlab.operators.metrics import auc
    from ordlab.operators.models import linear_score
    from ordlab.operators.ranking import pairwise_fit
    d = explained(spark, sf)
    w = pairwise_fit(d.filter(~F.col("test")), FEATURES, "y", "p_partkey", iters=6)
    s = d.filter(F.col("test")).select("p_partkey", (F.col("y") > 4).cast("int").alias("hi"), linear_score(w, FEATURES).alias("score"))
    return auc(s, "hi", "score", "p_partkey").select(F.lit("pairwise_all").alias("model"), round6("auc").alias("auc_high_classes"))


SQL_GRAM = f"""with p as ({SQL_EXPLAINED}),
f as (select r.run, p.* from p, (select cast(unnest(generate_series(1, 3)) as integer) run) r
      where {SQL_SPLIT_KEY.format(run='r.run', id='p_partkey')} >= 2000),
x as (select run, 'f_brand' feature, f_size a, f_brand b, y from f union all select run, 'f_price', f_size, f_price, y from f),
m as (select run, feature, avg(a) ma, avg(b) mb, avg(y) my, var_pop(a) aa, var_pop(b) bb, covar_pop(a, b) ab, covar_pop(a, y) ay,
             covar_pop(b, y) by_ from x group by all),
c as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) wb from m)
select run, feature, round(my - wa * ma - wb * mb, 6) intercept, round(wa, 6) w_base, round(wb, 6) w_candidate from c"""


@query("add_one_gram", SQL_GRAM)
def q_add_one_gram(spark, sf):
    """Base feature plus one candidate, fitted for three runs from one aggregate."""
    from ordlab.operators import tune
    d = explained(spark, sf)
    folds = fold_table(d.select(F.col("p_partkey").alias("id")), "id", runs=3)
    feats = ["f_size", "f_brand", "f_price"]
    fits = tune.add_one_fits(tune.gram_table(d, folds, feats, "y", "p_partkey"), feats, ["f_size"], feats[1:])
    return spark.createDataFrame([(r, x, round(i, 6), round(w["f_size"], 6), round(w[x], 6)) for r, x, i, w in fits],
                                 "run int, feature string, intercept double, w_base double, w_candidate double")


@query("forward_linear_test")
def q_forward_linear_test(spark, sf):
    """Kappa of each added feature over three runs from one aggregate and one scoring job."""
    from ordlab.operators import tune
    d = explained(spark, sf)
    folds = fold_table(d.select(F.col("p_partkey").alias("id")), "id", runs=3)
    k = tune.forward_linear_test(d, folds, ["f_size"], FEATURES[1:], "y", "p_partkey", [j + 0.5 for j in range(1, 8)])
    return k.select("feature", round6("kappa_mean").alias("kappa_mean"), round6("kappa_std").alias("kappa_std"))


#: parameters that the proposer searches for a tree on the explained label
TREE_SPACE = {"maxDepth": ("quniform", 1, 9, 1), "minInstancesPerNode": ("loguniform", 1.0, 300.0), "minInfoGain": ("uniform", 0.0, 0.5)}


@query("param_proposer_log")
def q_param_proposer_log(spark, sf):
    """16 trials proposed in batches of four from the log so far, cross-validated by kappa."""
    from pyspark.ml.regression import DecisionTreeRegressor
    from ordlab.operators import propose as pr
    from ordlab.operators.models import KappaEvaluator
    d = explained(spark, sf).filter(~F.col("test"))
    est = DecisionTreeRegressor(labelCol="y", featuresCol="features", seed=1)
    log = pr.search(pr.cv_evaluator(d, FEATURES, "p_partkey", est, KappaEvaluator(labelCol="y", cuts=[k + 0.5 for k in range(1, 8)])),
                    TREE_SPACE, trials=16, batch=4, start=8)
    best = max(t["kappa_mean"] for t in log)
    rows = [(t["trial"], *[float(t[k]) for k in TREE_SPACE], t["kappa_mean"], t["kappa_std"], t["kappa_mean"] == best) for t in log]
    return spark.createDataFrame(rows, "trial int, " + ", ".join(f"{k} double" for k in TREE_SPACE) + ", kappa_mean double, kappa_std double, best boolean")


@query("extra_trees")
def q_extra_trees(spark, sf):
    """Trees on random thresholds; error of the test rows beside that of the train mean."""
    from ordlab.operators.extra_trees import extra_trees
    d = explained(spark, sf)
    train, test = d.filter(~F.col("test")), d.filter(F.col("test"))
    m = extra_trees(train, FEATURES, "y", trees=8, depth=7, feature_share=0.75)
    mean = train.agg(F.avg("y").alias("m")).scalar()
    e = m.predict(test).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("rmse"), F.sqrt(F.avg((F.col("y") - mean) ** 2)).alias("rmse_mean"))
    return e.select(F.lit(len(m.trees)).alias("trees"), round6("rmse").alias("rmse"), round6("rmse_mean").alias("rmse_mean"))


def _sql_hook(value: str) -> str:
    """Kappa of ``value`` decoded by the class CDF of the same rows."""
    return f"""v as (select id, y, {value} s from ps),
h as (select y cls, count(*) c from ps group by y),
cd as (select cls, sum(c) over (order by cls rows unbounded preceding) / cast(sum(c) over () as double) f from h),
g as (select cls, f, coalesce(lag(f) over (order by cls), 0e0) pf from cd),
r as (select y, row_number() over (order by s, id) - 1 r, count(*) over () n from v),
d as (select r.y, coalesce(g.cls, 8) c from r left join g on g.cls < 8 and r.r >= (case when g.cls = 1 then 0 else floor(r.n * g.pf) end)
      and r.r < floor(greatest(r.n * g.f - 1, 0e0)))
select 1 - sum((y - c) * (y - c)) / (count(*) * (var_pop(y) + var_pop(c) + (avg(y) - avg(c)) ^ 2)) from d"""


_P = "list_transform(s, lambda x: exp(x - list_max(s)))"
_HOOK_VALUES = {
    "cdf": "s[1]",
    "softmax": "list_sum(list_transform(generate_series(1, 8), lambda j: j * s[j]))",
    "softkappa": f"list_sum(list_transform(generate_series(1, 8), lambda j: j * ({_P})[j] / list_sum({_P})))",
    "ebc": "1e0 + list_sum(list_transform(s[1:7], lambda x: 1e0 / (1e0 + exp(-x))))",
    "cocr": "1e0 + list_sum(s)",
}
_KAPPA = "1 - sum((y - c) * (y - c)) / (count(*) * (var_pop(y) + var_pop(c) + (avg(y) - avg(c)) ^ 2))"
SQL_HOOKS = "\nunion all\n".join(
    [f"select '{k}' kind, round((with ps as ({SQL_PART_SCORES}), {_sql_hook(v)}), 6) kappa" for k, v in _HOOK_VALUES.items()]
    + [f"select 'ebc_hard', round((select {_KAPPA} from (select y, 1 + len(list_filter(s[1:7], lambda x: x > 0)) c from ({SQL_PART_SCORES}))), 6)"])


@query("evaluation_hooks", SQL_HOOKS)
def q_evaluation_hooks(spark, sf):
    """The kappa of each hook on eight class scores per part (the CDF hook on the first one)."""
    p = part_scores(spark, sf).select("id", "y", "s")
    cdf = class_cdf(p, "y")
    out = None
    for kind in [*_HOOK_VALUES, "ebc_hard"]:
        d = p.withColumn("s", F.col("s")[0]) if kind == "cdf" else p
        k = qwk(hk.decode_kind(d, kind, "s", "id", cdf), "y", "cls").select(F.lit(kind).alias("kind"), round6("kappa").alias("kappa"))
        out = k if out is None else out.unionByName(k)
    return out
