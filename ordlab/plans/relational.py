"""Relational helper and sink queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import decode as dc
from ordlab.operators import ensemble as en
from ordlab.operators import frame as fr
from ordlab.operators import profile as pf
from ordlab.operators.rank import position, rows_between, window_position
from ordlab.plans.catalog import T, query
from ordlab.plans.ensembles import SQL_MODELS, model_preds
from ordlab.plans.holdout import SQL_HOLDOUT_FORMULA_KAPPA, formula_holdout_kappa
from ordlab.plans.standins import SQL_KEY, SQL_ORDERS_BASE, SQL_SPLIT_KEY, orders_scored, split_col, sql_split
from ordlab.session import checkpoint_dir
from ordlab.sources import files


def _scratch(spark, tag):
    return os.path.join(checkpoint_dir(spark), f"ordlab-{tag}-{uuid.uuid4().hex}")


@query("value_counts", "select o_orderpriority, count(*) n from orders group by 1")
def q_value_counts(spark, sf):
    """A4."""
    return pf.value_counts(T(spark, sf, "orders"), "o_orderpriority")


@query("group_sum", "select o_orderstatus, round(sum(o_totalprice), 6) total from orders group by 1")
def q_group_sum(spark, sf):
    """A5."""
    g = pf.group_sum(T(spark, sf, "orders"), "o_orderstatus", "o_totalprice")
    return g.select("o_orderstatus", round6("total").alias("total"))


@query("split_counts", f"select {sql_split('o_orderkey')} split, count(*) n from orders group by 1")
def q_split_counts(spark, sf):
    """Rows per split."""
    return pf.split_counts(T(spark, sf, "orders").withColumn("split", split_col("o_orderkey")))


@query("distinct_sorted", "select distinct o_orderstatus from orders")
def q_distinct_sorted(spark, sf):
    """A12."""
    return pf.distinct_sorted(T(spark, sf, "orders"), "o_orderstatus")


@query("run_summary", f"""with k as ({SQL_HOLDOUT_FORMULA_KAPPA})
select round(avg(kappa), 6) kappa_mean, round(stddev_pop(kappa), 6) kappa_std,
       arg_max(run, kappa) best_run, round(max(kappa), 6) best_kappa from k""")
def q_run_summary(spark, sf):
    """Mean and population std of the per-run kappas of the
    flagship, and the best run (max_by)."""
    k = formula_holdout_kappa(spark, sf)
    ms = pf.mean_std(k, "kappa", prefix="kappa_")
    best = pf.best_row(k, "kappa", "run", carry=["run", "kappa"])
    out = fr.attach(ms, best.select(F.col("run").alias("best_run"), F.col("kappa").alias("best_kappa")))
    return out.select(round6("kappa_mean").alias("kappa_mean"), round6("kappa_std").alias("kappa_std"),
                      "best_run", round6("best_kappa").alias("best_kappa"))


@query("rows_by_ids", """
select o.o_orderkey from orders o
where o.o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def q_rows_by_ids(spark, sf):
    """Orders of the customers in one segment (semi join on the id table)."""
    ids = T(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("o_custkey"))
    return fr.rows_with_ids(T(spark, sf, "orders"), ids, "o_custkey").select("o_orderkey")


@query("rows_by_position", """
select o_orderkey from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 p from orders)
where p between 1000 and 5999""")
def q_rows_by_position(spark, sf):
    """P10: the rows at positions 1000..5999 in date order (the range is the feature)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rows_between(o, ["o_orderdate", "o_orderkey"], 1000, 5999).select("o_orderkey")


@query("top_models", """
with t as (select p_type model, avg(sin(p_retailprice) * 5e-1 + p_size / 1e2) kappa_mean from part group by 1)
select model, round(kappa_mean, 6) kappa_mean from t order by kappa_mean desc, model limit 3""")
def q_top_models(spark, sf):
    """Models sorted by mean score, first ``init_top_k = 3`` (the limit is the feature)."""
    p = T(spark, sf, "part").select(F.col("p_type").alias("model"),
                                    (F.sin("p_retailprice") * 0.5 + F.col("p_size") / 1e2).alias("k"))
    m = p.groupBy("model").agg(F.avg("k").alias("kappa_mean"))
    return m.orderBy(F.desc("kappa_mean"), "model").limit(3).select(
        "model", round6("kappa_mean").alias("kappa_mean"))


@query("sample_models", f"""
with t as (select p_partkey trial, p_type model from part),
d as (select unnest(generate_series(1, 3)) draw)
select t.trial, t.model, 'plain' kind, cast(0 as integer) draw from t
where {SQL_SPLIT_KEY.format(run='7', id='t.trial')} < 3000
union all
select t.trial, t.model, 'replace' kind, cast(d.draw as integer) draw from t, d
where {SQL_SPLIT_KEY.format(run='7000 + d.draw', id='t.trial')} < 3000""")
def q_sample_models(spark, sf):
    """T5: seeded model subsets without and with replacement (3 draws of 30 %)."""
    t = T(spark, sf, "part").select(F.col("p_partkey").alias("trial"), F.col("p_type").alias("model"))
    a = fr.sample_models(t, "trial", 0.3, seed=7).select("trial", "model", F.lit("plain").alias("kind"),
                                                          F.lit(0).alias("draw"))
    b = fr.sample_models(t, "trial", 0.3, seed=7, replace=True, draws=3).select(
        "trial", "model", F.lit("replace").alias("kind"), F.col("draw").cast("int"))
    return a.unionByName(b)


@query("running_blend", f"""with {SQL_MODELS.strip()},
w as (select * from (values ('m1', 1, 5e-1), ('m2', 2, 3e-1), ('m3', 3, 2e-1), ('m4', 4, 1e0)) t(model, ord, weight)),
j as (select m.id, w.model, w.ord, w.weight, m.prediction from models m join w using (model))
select id, model, round(sum(weight * prediction) over (partition by id order by ord rows unbounded preceding)
  / sum(weight) over (partition by id order by ord rows unbounded preceding), 6) blend from j""")
def q_running_blend(spark, sf):
    """Running weighted mean over the ordered model list, per order."""
    w = spark.createDataFrame([("m1", 1, 0.5), ("m2", 2, 0.3), ("m3", 3, 0.2), ("m4", 4, 1.0)],
                              "model string, ord int, weight double")
    p = model_preds(spark, sf).join(F.broadcast(w), "model")  # one row per model
    return en.running_blend(p, "ord").select("id", "model", round6("blend").alias("blend"))


@query("vector_roundtrip", """
with h as (select cast((o_custkey % 8) + 1 as integer) cls, count(*) c from orders group by 1)
select cast(cls - 1 as bigint) ix,
       round(sum(c) over (order by cls rows unbounded preceding) / cast(sum(c) over () as double), 6) value from h""")
def q_vector_roundtrip(spark, sf):
    """The class CDF written one number per line and read back in order."""
    cdf = pf.class_cdf(orders_scored(spark, sf), "y")
    path = _scratch(spark, "cdf")
    files.write_vector(cdf, path, "cdf", ["cls"])
    back = files.read_vector(spark, path)
    ranked = window_position(back, ["ix"], "pos")  # one row per class
    return ranked.select(F.col("pos").cast("bigint").alias("ix"), round6("value").alias("value"))


@query("libsvm_roundtrip", """
select cast((p_size % 8) + 1 as double) label,
       [cast(p_size as double), p_retailprice, p_retailprice - 1e3, cast(p_partkey % 13 as double)] features
from part""")
def q_libsvm_roundtrip(spark, sf):
    """Label + feature vector written in svmlight form and read back
    (zeros are dropped by the format and restored on read)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    p = T(spark, sf, "part").select(
        ((F.col("p_size") % 8) + 1).cast("double").alias("label"), F.col("p_size").cast("double").alias("a"),
        "p_retailprice", (F.col("p_retailprice") - F.lit(1e3)).alias("s"), (F.col("p_partkey") % 13).cast("double").alias("k"))
    v = VectorAssembler(inputCols=["a", "p_retailprice", "s", "k"], outputCol="features").transform(p)
    path = _scratch(spark, "libsvm")
    files.write_libsvm(v, path)
    back = files.read_libsvm(spark, path, num_features=4)
    return back.select("label", vector_to_array("features").alias("features"))


SQL_DECODED = f"""
with b as (select o_orderkey id, o_orderstatus, o_totalprice / 6.25e4 s, cast((o_custkey % 8) + 1 as integer) y from orders),
h as (select y, count(*) c from b group by y),
cdf as (select y, sum(c) over (order by y rows unbounded preceding) / cast(sum(c) over () as double) f from h),
g as (select y, f, coalesce(lag(f) over (order by y), 0e0) pf from cdf),
r as (select id, o_orderstatus, s, row_number() over (order by s, id) - 1 r, count(*) over () n from b),
d as (select r.id, r.o_orderstatus, r.s, r.r, cast(coalesce(g.y, 8) as integer) class_cdf
      from r left join g on g.y < 8
       and r.r >= (case when g.y = 1 then 0 else floor(r.n * g.pf) end)
       and r.r < floor(greatest(r.n * g.f - 1, 0e0)))
select id, o_orderstatus, round(s, 6) raw, r rank, class_cdf,
       cast(1 + """ + " + ".join(f"case when s > {c}e0 then 1 else 0 end" for c in
                                  [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]) + """ as integer) class_cut
from d"""


@query("prediction_table", SQL_DECODED)
def q_prediction_table(spark, sf):
    """The prediction table (raw, rank, CDF class, cut class) written
    partitioned by order status and read back."""
    o = orders_scored(spark, sf).select("id", "y", "score", "o_orderstatus")
    ranked = position(o, ["score", "id"], "rank")
    d = dc.decode_cdf(ranked, "score", "id", pf.class_cdf(o, "y"), out="class_cdf")
    d = d.select("id", "o_orderstatus", F.col("score").alias("raw"), "rank", "class_cdf",
                 dc.decode_cut("score", [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]).alias("class_cut"))
    path = _scratch(spark, "pred")
    files.write_predictions(d, path, partition_by=("o_orderstatus",))
    back = spark.read.parquet(path)
    return back.select("id", "o_orderstatus", round6("raw").alias("raw"), "rank", "class_cdf", "class_cut")


@query("template_fill", f"""with ob as ({SQL_ORDERS_BASE})
select id "Id", cast(1 + """ + " + ".join(f"case when score > {c}e0 then 1 else 0 end" for c in
                                          [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]) + """ as integer) "Response"
from ob""")
def q_template_fill(spark, sf):
    """A submission template's ``Response`` column replaced by the
    decoded predictions, joined on the id (not by position)."""
    o = orders_scored(spark, sf)
    template = o.select(F.col("id").alias("Id"), F.lit(0).alias("Response"))
    pred = o.select(F.col("id").alias("Id"), dc.decode_cut("score", [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5])
                    .alias("Response"))
    return files.template_fill(template, pred, "Id", "Response")


@query("frame_ops", """
with c as (select c_custkey, c_mktsegment, c_acctbal from customer),
o as (select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders)
select o.o_orderkey, 0 flag, o.o_custkey,
       case when o.o_orderstatus = 'P' then -1e0 else o.o_totalprice end price,
       c.c_mktsegment, round(c.c_acctbal, 6) acct
from o left join c on c.c_custkey = o.o_custkey""")
def q_frame_ops(spark, sf):
    """Project, drop by set difference,
    insert a constant column at a position, overwrite where a mask holds,
    and copy columns from another table by key."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                      "o_orderdate")
    o = fr.project(o, fr.columns_except(o, ["o_orderdate"]))
    o = fr.insert_column(o, "flag", F.lit(0), 1)
    o = fr.overwrite_where(o, "o_totalprice", F.col("o_orderstatus") == "P", -1.0).withColumnRenamed(
        "o_totalprice", "price")
    cu = T(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    o = fr.copy_columns(o, cu, "o_custkey", ["c_mktsegment"])
    o = fr.lookup(o, cu, "o_custkey", "c_acctbal", "acct")
    return fr.drop(o, ["o_orderstatus"]).select("o_orderkey", "flag", "o_custkey", "price", "c_mktsegment",
                                                round6("acct").alias("acct"))


@query("class_argmax", """
with ps as (select p_partkey id,
  [sin(p_retailprice / 100e0 + 1e0) + cast((p_size % 8 + 1) - 1 as double) / 8e0,
   sin(p_retailprice / 100e0 + 2e0) + cast((p_size % 8 + 1) - 2 as double) / 8e0,
   sin(p_retailprice / 100e0 + 3e0) + cast((p_size % 8 + 1) - 3 as double) / 8e0,
   sin(p_retailprice / 100e0 + 4e0) + cast((p_size % 8 + 1) - 4 as double) / 8e0,
   sin(p_retailprice / 100e0 + 5e0) + cast((p_size % 8 + 1) - 5 as double) / 8e0,
   sin(p_retailprice / 100e0 + 6e0) + cast((p_size % 8 + 1) - 6 as double) / 8e0,
   sin(p_retailprice / 100e0 + 7e0) + cast((p_size % 8 + 1) - 7 as double) / 8e0,
   sin(p_retailprice / 100e0 + 8e0) + cast((p_size % 8 + 1) - 8 as double) / 8e0] s from part)
select id, cast(list_position(s, list_max(s)) as integer) cls from ps""")
def q_class_argmax(spark, sf):
    """Row-wise argmax over eight class scores (first maximum)."""
    from ordlab.functions.scalar import row_argmax
    from ordlab.plans.standins import part_scores
    return part_scores(spark, sf).select("id", row_argmax("s").cast("int").alias("cls"))


@query("csv_rownum_roundtrip", """
select row_number() over (order by o_orderdate, o_orderkey) - 1 rn, o_orderkey, o_orderstatus from orders""")
def q_csv_rownum_roundtrip(spark, sf):
    """CSV sink with an explicit row-number column (scalable position in
    date order), read back with a schema."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    path = _scratch(spark, "csvrn")
    files.write_csv(o.select("o_orderkey", "o_orderstatus", "o_orderdate"), path, row_number_col="rn",
                    order_by=["o_orderdate", "o_orderkey"])
    back = files.read_csv(spark, path, "rn bigint, o_orderkey bigint, o_orderstatus string, o_orderdate timestamp")
    return back.select("rn", "o_orderkey", "o_orderstatus")
