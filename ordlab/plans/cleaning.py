"""Cleaning queries: null profile, fills, ridge imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import clean
from ordlab.operators.features import code_split
from ordlab.operators.profile import null_profile
from ordlab.operators.split import holdout
from ordlab.plans.catalog import T, query
from ordlab.plans.standins import (SQL_DOCS_LABELLED, SQL_SPLIT_KEY, docs_labelled, split_col,
                                   sql_split)

DL = f"with dl as ({SQL_DOCS_LABELLED})"

SQL_NULL_PROFILE = DL + "\n" + "\nunion all\n".join(
    f"select '{c}' as \"column\", round(avg(case when {c} is null then 1e0 else 0e0 end), 6) null_rate, "
    f"avg(case when {c} is null then 1e0 else 0e0 end) > 1e-1 flagged from dl"
    for c in ["doc_id", "lang", "source", "n_chars", "quality", "toxic"])


@query("null_profile", SQL_NULL_PROFILE)
def q_null_profile(spark, sf):
    import os
    import uuid
    from ordlab.session import checkpoint_dir
    from ordlab.sources import files
    p = null_profile(docs_labelled(spark, sf), ["doc_id", "lang", "source", "n_chars", "quality", "toxic"])
    path = os.path.join(checkpoint_dir(spark), f"ordlab-report-{uuid.uuid4().hex}")
    files.write_report(p, path)  # S11: the null-rate report sink
    back = spark.read.schema("column string, null_rate double, flagged boolean").json(path)
    return back.select("column", round6("null_rate").alias("null_rate"), "flagged")


@query("fill_sentinel", DL + """
select doc_id, cast(coalesce(quality, -1) as integer) quality, cast(coalesce(toxic, -1) as integer) toxic from dl""")
def q_fill_sentinel(spark, sf):
    d = docs_labelled(spark, sf).select("doc_id", "quality", "toxic")
    return clean.fill_sentinel(d, ["quality", "toxic"], -1)


@query("fill_mean_by_split", DL + f"""
, s as (select doc_id, quality, toxic, {sql_split('doc_id')} split from dl)
select doc_id, split,
  round(coalesce(cast(quality as double), avg(quality) over (partition by split)), 6) quality,
  round(coalesce(cast(toxic as double), avg(toxic) over (partition by split)), 6) toxic
from s""")
def q_fill_mean_by_split(spark, sf):
    d = docs_labelled(spark, sf).select("doc_id", "quality", "toxic").withColumn("split", split_col("doc_id"))
    f = clean.fill_mean(d, ["quality", "toxic"], by=["split"])
    return f.select("doc_id", "split", round6("quality").alias("quality"), round6("toxic").alias("toxic"))


@query("fill_mean_all", DL + """
select doc_id, round(coalesce(cast(quality as double), avg(quality) over ()), 6) quality from dl""")
def q_fill_mean_all(spark, sf):
    d = docs_labelled(spark, sf).select("doc_id", "quality")
    return clean.fill_mean(d, ["quality"]).select("doc_id", round6("quality").alias("quality"))


@query("fill_median", DL + """
, m as (select median(cast(n_chars * quality as double)) md from dl)
select doc_id, round(coalesce(cast(n_chars * quality as double), m.md), 6) chars_q from dl, m""")
def q_fill_median(spark, sf):
    d = docs_labelled(spark, sf).select("doc_id", (F.col("n_chars") * F.col("quality")).alias("chars_q"))
    return clean.fill_median(d, ["chars_q"]).select("doc_id", round6("chars_q").alias("chars_q"))


@query("fill_unknown_code", DL + """
, z as (select doc_id, coalesce(case when quality is null then null else lang end, 'Z0') code from dl)
select doc_id, code, substr(code, 1, 1) code_letter, substr(code, 2) code_number from z""")
def q_fill_unknown_code(spark, sf):
    d = docs_labelled(spark, sf).select("doc_id", F.when(F.col("quality").isNull(), F.lit(None))
                                        .otherwise(F.col("lang")).alias("code"))
    d = clean.fill_unknown_code(d, "code")
    return code_split(d, "code")


ALPHA = 1.0


@query("impute_ridge_single", DL + f"""
, s as (select doc_id, n_chars, quality, {sql_split('doc_id')} split from dl),
fit as (select split, regr_sxy(cast(quality as double), cast(n_chars as double)) sxy,
               regr_sxx(cast(quality as double), cast(n_chars as double)) sxx,
               avg(case when quality is not null then cast(n_chars as double) end) mx,
               avg(cast(quality as double)) my from s group by split)
select s.doc_id, s.split,
  round(coalesce(cast(s.quality as double),
        round_even(fit.my - fit.sxy / nullif(fit.sxx * {1.0 + ALPHA}e0, 0e0) * fit.mx
                   + fit.sxy / nullif(fit.sxx * {1.0 + ALPHA}e0, 0e0) * s.n_chars, 0)), 6) quality_filled
from s join fit on fit.split = s.split""")
def q_impute_ridge_single(spark, sf):
    d = docs_labelled(spark, sf).select("doc_id", "n_chars", "quality").withColumn("split", split_col("doc_id"))
    f = clean.impute_ridge_single(d, "n_chars", "quality", ALPHA, by=["split"], categorical=True)
    return f.select("doc_id", "split", round6("quality_filled").alias("quality_filled"))


@query("impute_ridge_multi")
def q_impute_ridge_multi(spark, sf):
    """C6 with several predictors (no oracle; tests check it against numpy)."""
    d = docs_labelled(spark, sf).select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.length("source").cast("double").alias("src_len"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("is_en"), "quality"
    ).withColumn("split", split_col("doc_id"))
    f = clean.impute_ridge_multi(d, ["n_chars", "src_len", "is_en"], "quality", ALPHA, by="split",
                                 categorical=True)
    return f.select("doc_id", "split", "quality_filled")


@query("impute_vs_constant", f"""
with p as (select p_partkey id, cast(p_size as double) x, p_retailprice y from part),
f as (select r.run, p.*, case when {SQL_SPLIT_KEY.format(run='r.run', id='p.id')} < 3000 then 'test' else 'train' end role
      from p, (select cast(unnest(generate_series(1, 3)) as integer) run) r),
fit as (select run, regr_sxy(y, x) / (regr_sxx(y, x) * {1.0 + ALPHA}e0) slope, avg(x) mx, avg(y) my
        from f where role = 'train' group by run),
e as (select f.run, f.y, fit.my + fit.slope * (f.x - fit.mx) pm, fit.my pc
      from f join fit on fit.run = f.run where f.role = 'test')
select run, round(avg((pm - y) * (pm - y)), 6) mse_model, round(avg((pc - y) * (pc - y)), 6) mse_const,
       round(-abs(avg((pm - y) * (pm - y)) - avg((pc - y) * (pc - y))), 6) score
from e group by run""")
def q_impute_vs_constant(spark, sf):
    """Learned (ridge) vs constant (mean) imputation of p_retailprice from
    p_size, scored ``-|MSE_model - MSE_const|`` on three 30 % holdouts."""
    p = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"),
                                    F.col("p_retailprice").alias("y"))
    f = holdout(p, "id", runs=3, test_fraction=0.3)
    fit = clean.ridge_single_fit(f.filter(F.col("role") == "train"), "x", "y", ALPHA, by=["run"])
    mean = f.filter(F.col("role") == "train").groupBy("run").agg(F.avg("y").alias("pc"))
    e = (f.filter(F.col("role") == "test").join(fit, "run").join(mean, "run")
         .withColumn("pm", F.col("intercept") + F.col("slope") * F.col("x")))
    g = e.groupBy("run").agg(F.avg((F.col("pm") - F.col("y")) ** 2).alias("mm"),
                             F.avg((F.col("pc") - F.col("y")) ** 2).alias("mc"))
    return g.select("run", round6("mm").alias("mse_model"), round6("mc").alias("mse_const"),
                    round6(-F.abs(F.col("mm") - F.col("mc"))).alias("score"))
