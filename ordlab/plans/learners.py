"""Learner queries.

Model results have no SQL oracle; the driver checks rows and the tests
check each against a closed form or a bound (better than the mean
predictor, probabilities in range, importances summing to one, ...).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import models as md
from ordlab.operators import tune
from ordlab.operators.decode import decode_cut
from ordlab.operators.frame import attach
from ordlab.operators.metrics import qwk, regression_errors
from ordlab.operators.profile import best_row, normalized
from ordlab.operators.split import fold_table, holdout
from ordlab.plans.catalog import query
from ordlab.plans.selection import PART_FEATURES, part_features
from ordlab.plans.standins import SQL_PART_SCORES, docs_labelled, split_col, sql_split
from ordlab.session import dealt, materialize

FEATS = list(PART_FEATURES)
CUTS = [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]


def wide(spark, sf):
    """Part stand-in: eight numeric features, ordinal label ``y``, split tag."""
    return part_features(spark, sf).withColumn("yd", F.col("y").cast("double")) \
        .withColumn("split", split_col("p_partkey"))


def _report(spark, name, pred, label="yd"):
    """``(model, n_test, rmse, kappa)`` of a ``prediction`` column on the test rows."""
    e = regression_errors(pred, label, "prediction")
    k = qwk(pred.withColumn("cls", decode_cut("prediction", CUTS)), "y", "cls")
    n = pred.agg(F.count(F.lit(1)).alias("n_test"))
    out = attach(attach(n, e.select("rmse")), k.select("kappa"))
    return out.select(F.lit(name).alias("model"), "n_test", round6("rmse").alias("rmse"),
                      round6("kappa").alias("kappa"))


def _split(spark, sf):
    w = materialize(dealt(wide(spark, sf), "p_partkey"), "wide")
    return w.filter(F.col("split") == "train"), w.filter(F.col("split") == "test")


@query("ridge")
def q_ridge(spark, sf):
    """Normalised ridge (alpha 1) and the unnormalised form (alpha 2500)."""
    tr, te = _split(spark, sf)
    a = md.ridge(tr, FEATS, "yd", 1.0, normalize=True)
    b = md.ridge(tr, FEATS, "yd", 2500.0, normalize=False)
    return _report(spark, "ridge_norm", a.transform(md.assemble(te, FEATS))).unionByName(
        _report(spark, "ridge_plain", b.transform(md.assemble(te, FEATS))))


@query("lasso")
def q_lasso(spark, sf):
    """Normalised lasso."""
    tr, te = _split(spark, sf)
    m = md.lasso(tr, FEATS, "yd", 1e-3)
    return _report(spark, "lasso", m.transform(md.assemble(te, FEATS)))


@query("logistic_balanced")
def q_logistic_balanced(spark, sf):
    """Class-balanced logistic regression of document quality."""
    d = docs_labelled(spark, sf).filter(F.col("quality").isNotNull()).select(
        "doc_id", F.col("quality").cast("double").alias("label"),
        F.ln("n_chars").alias("ln_chars"), F.length("source").cast("double").alias("src_len"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("is_en"))
    feats = ["ln_chars", "src_len", "is_en"]
    m = md.logistic_balanced(d, feats, "label", C=1.0)
    from ordlab.operators.metrics import auc
    from pyspark.ml.functions import vector_to_array
    p = m.transform(md.assemble(md.balanced_weights(d, "label"), feats)) \
        .withColumn("p1", vector_to_array("probability")[1])
    a = auc(p, "label", "p1", "doc_id")
    return a.select(F.lit("logistic_balanced").alias("model"), round6("auc").alias("auc"),
                    *[F.lit(float(v)).alias(f"coef_{f}") for f, v in zip(feats, m.coefficients)])


@query("poisson_glm")
def q_poisson_glm(spark, sf):
    """L3: Poisson regression with log link."""
    tr, te = _split(spark, sf)
    m = md.poisson_glm(tr, FEATS, "yd")
    return _report(spark, "poisson", m.transform(md.assemble(te, FEATS)))


@query("linear_models")
def q_linear_models(spark, sf):
    """Elastic-net linear model and the Huber-loss robust linear model."""
    tr, te = _split(spark, sf)
    a = md.linear_booster(tr, FEATS, "yd", 0.01, 0.5)
    b = md.huber_linear(tr, FEATS, "yd")
    return _report(spark, "elastic_net", a.transform(md.assemble(te, FEATS))).unionByName(
        _report(spark, "huber", b.transform(md.assemble(te, FEATS))))


@query("forest")
def q_forest(spark, sf):
    """Random forest (28 % features per split) and the extra-trees
    approximation (no bootstrap)."""
    tr, te = _split(spark, sf)
    a = md.forest(tr, FEATS, "yd", trees=40, depth=8)
    b = md.forest(tr, FEATS, "yd", trees=40, depth=8, bootstrap=False)
    return _report(spark, "forest", a.transform(md.assemble(te, FEATS))).unionByName(
        _report(spark, "extra_trees", b.transform(md.assemble(te, FEATS))))


@query("gbt_early_stop")
def q_gbt_early_stop(spark, sf):
    """L1/L2: boosted trees with a 20 % holdout of the train part; the best
    round is refitted on the whole train part."""
    tr, te = _split(spark, sf)
    trv = tr.withColumn("is_valid", split_col("p_partkey", 0.2, F.lit(7)) == "test")
    m, best, _ = md.gbt_early_stop(trv, FEATS, "yd", "is_valid", max_iter=40, step=0.1, depth=4)
    return _report(spark, "gbt", m.transform(md.assemble(te, FEATS))).withColumn("best_round", F.lit(best))


@query("pairwise_rank")
def q_pairwise_rank(spark, sf):
    """Pairwise ranking with one hashed partner per row; score = w . x."""
    tr, te = _split(spark, sf)
    m = md.pairwise_rank(tr, FEATS, "y", "p_partkey")
    s = te.select("p_partkey", "y", md.linear_score(m.coefficients, FEATS).alias("score"))
    from ordlab.operators.metrics import auc
    pairs_auc = auc(s.withColumn("hi", (F.col("y") > 4).cast("int")), "hi", "score", "p_partkey")
    return pairs_auc.select(F.lit("pairwise_rank").alias("model"), round6("auc").alias("auc_high_classes"))


@query("softmax_clf")
def q_softmax_clf(spark, sf):
    """Multinomial logistic and random-forest class probabilities,
    decoded by expected class and scored."""
    tr, te = _split(spark, sf)
    from pyspark.ml.functions import vector_to_array
    from ordlab.functions.scalar import expected_class
    out = None
    for kind in ("softmax", "rf"):
        m = md.class_probabilities(tr, FEATS, "y", kind)
        p = m.transform(te).withColumn("prediction", expected_class(vector_to_array("probability")))
        r = _report(spark, kind, p.drop("features"))
        out = r if out is None else out.unionByName(r)
    return out


@query("leaf_linear")
def q_leaf_linear(spark, sf):
    """Boosted-tree leaves one-hot encoded, then ridge."""
    tr, te = _split(spark, sf)
    gbt, cv, lr = md.leaf_linear(tr, FEATS, "yd", trees=20, depth=3)
    from pyspark.ml.functions import vector_to_array
    t = gbt.transform(md.assemble(te, FEATS)).drop("prediction").withColumn(
        "leaf_tokens", F.transform(vector_to_array("leaf"), lambda x, i: F.concat(
            F.lit("t"), i.cast("string"), F.lit("_"), x.cast("int").cast("string"))))
    p = lr.transform(cv.transform(t))
    return _report(spark, "leaf_linear", p)


@query("stack_proba")
def q_stack_proba(spark, sf):
    """Mean class probabilities of three base classifiers fitted on 20 %
    of the train part, added as eight columns to the other rows."""
    tr, te = _split(spark, sf)
    tr = tr.withColumn("layer", split_col("p_partkey", 0.2, F.lit(11)))
    base = tr.filter(F.col("layer") == "test")
    models = [md.class_probabilities(base, FEATS, "y", k) for k in ("rf", "softmax", "tree")]
    st = md.stack_probabilities(models, te.select("p_partkey", "y", *FEATS))
    return st.select("p_partkey", *[round6(f"stack_p{k}").alias(f"stack_p{k}") for k in range(1, 9)])


@query("bagged_stack")
def q_bagged_stack(spark, sf):
    """Three bags; per bag base classifiers on a 20 % layer, a
    linear upper model on features + stacked probabilities, cut decode; the
    bags' classes are combined by majority vote."""
    from ordlab.operators.ensemble import vote_majority
    tr, te = _split(spark, sf)
    stack_cols = [f"stack_p{k}" for k in range(1, 9)]
    votes = te.select("p_partkey", "y", *FEATS)
    for bag in (1, 2, 3):
        t = tr.withColumn("layer", split_col("p_partkey", 0.2, F.lit(100 + bag)))
        base, upper = t.filter(F.col("layer") == "test"), t.filter(F.col("layer") == "train")
        models = [md.class_probabilities(base, FEATS, "y", k) for k in ("rf", "softmax")]
        # a linear fit reads its rows twice (sums, summary); they are scored once
        up = md.stack_probabilities(models, upper.select("yd", *FEATS)).persist()
        lr = md.linear_booster(up, FEATS + stack_cols, "yd", 0.01, 0.0)
        up.unpersist()
        ts = md.assemble(md.stack_probabilities(models, votes), FEATS + stack_cols)
        votes = lr.transform(ts).select(*votes.columns, decode_cut("prediction", CUTS).alias(f"c{bag}"))
    v = materialize(votes.select("p_partkey", "y", vote_majority(["c1", "c2", "c3"]).cast("int").alias("vote")), "votes")
    k = qwk(v, "y", "vote")
    return attach(v, k).select("p_partkey", "y", "vote", round6("kappa").alias("kappa"))


@query("ordinal_ebc_fit")
def q_ordinal_ebc_fit(spark, sf):
    """Extended-binary reduction trained with one weighted logistic model."""
    tr, te = _split(spark, sf)
    m, cols = md.ebc_fit(tr, FEATS, "y")
    s = md.ebc_predict(m, cols, te, "p_partkey", FEATS)
    p = s.join(te.select("p_partkey", "y", "yd"), "p_partkey").withColumnRenamed("score", "prediction")
    return _report(spark, "ebc", p)


@query("ordinal_cocr_fit")
def q_ordinal_cocr_fit(spark, sf):
    """Cost-sensitive regression reduction, one weighted model per class."""
    tr, te = _split(spark, sf)
    ms = md.cocr_fit(tr, FEATS, "y")
    s = md.cocr_predict(ms, te, "p_partkey", FEATS)
    p = s.join(te.select("p_partkey", "y", "yd"), "p_partkey").withColumnRenamed("score", "prediction")
    return _report(spark, "cocr", p)


@query("param_search_log")
def q_param_search_log(spark, sf):
    """Grid search with 3 hash folds and the kappa evaluator; the
    trial log plus a flag on the best trial."""
    from pyspark.ml.regression import LinearRegression
    tr, _ = _split(spark, sf)
    est = LinearRegression(labelCol="yd", featuresCol="features")
    log = tune.param_search(tr, FEATS, "y", "p_partkey", est,
                            {"regParam": [0.0, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}, folds=3, cuts=CUTS)
    import os
    import uuid
    from ordlab.session import checkpoint_dir
    from ordlab.sources import files
    path = os.path.join(checkpoint_dir(spark), f"ordlab-trials-{uuid.uuid4().hex}")
    files.append_trials(log, path)  # S8: the trial log sink (append mode)
    log = spark.read.parquet(path)
    best = best_row(log, "kappa_mean", "trial", carry=["trial"])
    return log.join(best.select("trial", F.lit(True).alias("best")), "trial", "left") \
        .withColumn("best", F.coalesce("best", F.lit(False)))


@query("cv_refit_predict")
def q_cv_refit_predict(spark, sf):
    """A GBT setting evaluated over three stored holdouts
    (mean/std kappa), then refitted on all train rows to emit the test
    prediction table (raw, rank, CDF class, cut class)."""
    from pyspark.ml.regression import GBTRegressor
    tr, te = _split(spark, sf)
    folds = fold_table(tr.select(F.col("p_partkey").alias("id")), "id", runs=3)

    def make():
        return GBTRegressor(labelCol="yd", featuresCol="features", maxIter=20, maxDepth=4, seed=1)

    k = tune.cv_evaluate(tr, folds, FEATS, "y", "p_partkey", make, "cut", CUTS)
    ms = k.agg(F.avg("kappa").alias("kappa_mean"), F.stddev_pop("kappa").alias("kappa_std"))
    pred = tune.refit_predict(tr, te, FEATS, "y", "p_partkey", make, CUTS)
    return attach(pred, ms).select("p_partkey", round6("raw").alias("raw"), "rank", "class_cdf", "class_cut",
                round6("kappa_mean").alias("kappa_mean"), round6("kappa_std").alias("kappa_std"))


@query("forward_feature_test")
def q_forward_feature_test(spark, sf):
    """Base features plus one candidate each, mean kappa over three runs."""
    from pyspark.ml.regression import DecisionTreeRegressor
    tr, _ = _split(spark, sf)
    folds = fold_table(tr.select(F.col("p_partkey").alias("id")), "id", runs=3)
    base = ["f_price", "f_key97"]
    cands = [f for f in FEATS if f not in base]
    return tune.forward_feature_test(
        tr, folds, base, cands, "yd", "p_partkey",
        lambda: DecisionTreeRegressor(labelCol="yd", featuresCol="features", maxDepth=6, seed=1), CUTS)


@query("importance_rank")
def q_importance_rank(spark, sf):
    """Forest importances, normalised to sum 1, ranked, and
    the top five feature names applied as a projection."""
    tr, _ = _split(spark, sf)
    m = md.forest(tr, FEATS, "yd", trees=30, depth=8)
    imp = spark.createDataFrame(md.importance_table(m, FEATS), "feature string, value double")
    from ordlab.sources.files import feature_map
    fmap = feature_map(tr, FEATS).select(F.col("name").alias("feature"), "type")  # S12, one row per feature
    imp = imp.join(fmap, "feature")
    share = normalized(imp, "value", "sum", "share")
    from ordlab.operators.rank import window_position
    ranked = window_position(share, [F.desc("value"), F.asc("feature")], "rank")  # one row per feature
    return ranked.select("feature", "type", round6("value").alias("value"), round6("share").alias("share"),
                         (F.col("rank") + 1).alias("rank"), (F.col("rank") < 5).alias("top5"))


@query("softkappa_linear")
def q_softkappa_linear(spark, sf):
    """Linear 8-output model trained by soft-kappa gradient steps;
    expected class of the softmax, reported on the test part."""
    tr, te = _split(spark, sf)
    W, b, mu, sd, hist = md.softkappa_linear_fit(tr, FEATS, "y", iters=12, lr=1.0)
    p = md.softkappa_linear_predict(te, FEATS, W, b, mu, sd)
    return _report(spark, "softkappa_linear", p).withColumn("grad_l1_last", F.lit(round(hist[-1], 6)))


SQL_SOFTKAPPA_PREDICTED = """with ps as ({ps}),
sm as (select id, cast(y as double) y, list_transform(s, lambda x: exp(x - list_max(s))) e from ps),
pr as (select id, y, list_transform(e, lambda x: x / list_sum(e)) p from sm),
m as (select id, y, p, list_sum(list_transform(generate_series(1, 8), lambda j: (y - j) * (y - j) * p[j])) m from pr),
gl as (select count(*) * 1e0 mm, sum(m) oo,
              list_transform(generate_series(1, 8), lambda j: 0e0) z,
              [sum(p[1]), sum(p[2]), sum(p[3]), sum(p[4]), sum(p[5]), sum(p[6]), sum(p[7]), sum(p[8])] hp,
              [sum(case when y = 1 then 1e0 else 0e0 end), sum(case when y = 2 then 1e0 else 0e0 end),
               sum(case when y = 3 then 1e0 else 0e0 end), sum(case when y = 4 then 1e0 else 0e0 end),
               sum(case when y = 5 then 1e0 else 0e0 end), sum(case when y = 6 then 1e0 else 0e0 end),
               sum(case when y = 7 then 1e0 else 0e0 end), sum(case when y = 8 then 1e0 else 0e0 end)] h
       from m),
ge as (select mm, oo, hp, h,
         list_sum(list_transform(generate_series(1, 8), lambda i: list_sum(list_transform(generate_series(1, 8),
           lambda j: (i - j) * (i - j) * h[i] * hp[j])))) ee,
         list_transform(generate_series(1, 8), lambda k: list_sum(list_transform(generate_series(1, 8),
           lambda l: (k - l) * (k - l) * h[l]))) c
       from gl),
r as (select m.id, m.y, m.p, m.m, ge.mm, ge.oo, ge.ee, ge.c,
             list_sum(list_transform(generate_series(1, 8), lambda k: m.p[k] * ge.c[k])) pc from m, ge),
lg as (select id, kk.k, y, m, mm, oo, ee, p[kk.k] pn, c[kk.k] ck, pc from r, (select unnest(generate_series(1, 8)) k) kk),
d as (select id, k, mm, oo, ee,
        pn * ((y - k) * (y - k) - m) d_o, pn * (ck - pc) d_e,
        pn * (1e0 - 2e0 * pn) * ((y - k) * (y - k) - m) d2_o, pn * (1e0 - 2e0 * pn) * (ck - pc) d2_e from lg),
q as (select id, k, mm * (d_o * ee - oo * d_e) / (ee * ee) g,
        mm * ((d2_o * ee - oo * d2_e) * ee * ee - (d_o * ee - oo * d_e) * 2e0 * ee * d_e) / (ee * ee * ee * ee) q from d)
select id, cast(k as integer) k, round(g * 1e6, 6) grad_e6, round(abs(q) * 1e0 / avg(abs(q)) over (), 6) hess from q
"""


@query("objective_softkappa_predicted",
       SQL_SOFTKAPPA_PREDICTED.format(ps=SQL_PART_SCORES))
def q_objective_softkappa_predicted(spark, sf):
    """The predicted-histogram soft-kappa gradient table (gradient times
    1e6, hess_scale 1)."""
    from ordlab.operators import objectives as ob
    from ordlab.plans.standins import part_scores
    o = ob.softkappa_predicted_hist(part_scores(spark, sf), "id", "y", "s", hess_scale=1.0)
    return o.select("id", "k", round6(F.col("grad") * F.lit(1e6)).alias("grad_e6"), round6("hess").alias("hess"))


SQL_STAGES = f"""
with o as (select o_orderkey, o_totalprice x, o_totalprice / 6.25e4 score, {sql_split('o_orderkey')} split from orders),
m as (select avg(x) m, stddev_pop(x) s from o where split = 'train')
select o_orderkey, round((x - m) / nullif(s, 0e0), 6) x_z,
       cast(1 + """ + " + ".join(f"case when score > {c}e0 then 1 else 0 end" for c in CUTS) + """ as integer) cls
from o, m"""


@query("ml_stages", SQL_STAGES)
def q_ml_stages(spark, sf):
    """UD4/S13/E13/D2: the population scaler (fit on train rows) and the
    right-closed cut decoder as ``pyspark.ml`` stages, saved to and loaded
    from the shared folder before use."""
    import os
    import uuid
    from pyspark.ml import PipelineModel
    from ordlab.operators.ml import CutDecoder, PopulationScaler
    from ordlab.plans.catalog import T
    from ordlab.session import checkpoint_dir
    o = T(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"),
                                      (F.col("o_totalprice") / 6.25e4).alias("score")) \
        .withColumn("split", split_col("o_orderkey"))
    scaler = PopulationScaler(inputCols=["x"], outputCols=["x_z"]).fit(o.filter(F.col("split") == "train"))
    pm = PipelineModel(stages=[scaler, CutDecoder(inputCol="score", outputCol="cls", cuts=CUTS)])
    path = os.path.join(checkpoint_dir(spark), f"ordlab-stages-{uuid.uuid4().hex}")
    pm.write().overwrite().save(path)
    back = PipelineModel.load(path)
    return back.transform(o).select("o_orderkey", round6("x_z").alias("x_z"), "cls")
