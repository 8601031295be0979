"""Encoding and derived-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import features as fe
from ordlab.operators.rank import batches
from ordlab.plans.catalog import T, query
from ordlab.plans.standins import SQL_DOCS_LABELLED, docs_labelled, split_col, sql_split


@query("label_encode", """
select o_orderkey, o_orderpriority,
       cast(dense_rank() over (order by o_orderpriority) - 1 as integer) o_orderpriority_code
from orders""")
def q_label_encode(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return fe.label_encode(o, "o_orderpriority")


@query("label_encode_per_split", """
select doc_id, lang, source, cast(dense_rank() over (partition by lang order by source) - 1 as integer) source_code
from documents""")
def q_label_encode_per_split(spark, sf):
    """Q5: codes refitted inside each group (here: per language)."""
    d = T(spark, sf, "documents").select("doc_id", "lang", "source")
    return fe.label_encode(d, "source", per_split="lang")


STATUS = ["F", "O", "P"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

SQL_ONE_HOT = f"""
with u as (
  select o_orderkey, o_orderstatus, o_orderpriority, cast((o_custkey % 8) + 1 as integer) y, 'train' split
  from orders where {sql_split('o_orderkey')} = 'train'
  union all
  select o_orderkey, o_orderstatus, o_orderpriority, cast(null as integer) y, 'test' split
  from orders where {sql_split('o_orderkey')} = 'test')
select o_orderkey, y, split,
""" + ",\n".join(
    [f"  case when o_orderstatus = '{v}' then 1 else 0 end \"o_orderstatus.{v}\"" for v in STATUS]
    + [f"  case when o_orderpriority = '{v}' then 1 else 0 end \"o_orderpriority.{v}\"" for v in PRIORITY]
) + "\nfrom u"


@query("one_hot", SQL_ONE_HOT)
def q_one_hot(spark, sf):
    """E3 with U1/U3: train (with label) and test (without) are unioned by
    name, one-hot encoded over the union, and stay split by the tag."""
    o = T(spark, sf, "orders").withColumn("split", split_col("o_orderkey"))
    train = (o.filter(F.col("split") == "train")
              .select("o_orderkey", "o_orderstatus", "o_orderpriority",
                      ((F.col("o_custkey") % 8) + 1).cast("int").alias("y"), "split"))
    test = o.filter(F.col("split") == "test").select("o_orderkey", "o_orderstatus", "o_orderpriority", "split")
    u = train.unionByName(test, allowMissingColumns=True)
    return fe.one_hot(u, ["o_orderstatus", "o_orderpriority"])


BRANDS = [f"Brand#{i}" for i in range(1, 26)]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

SQL_DICT_VECTORIZE = "select p_partkey, p_size,\n" + ",\n".join(
    [f"  case when p_brand = '{v}' then 1 else 0 end \"p_brand={v}\"" for v in BRANDS]
    + [f"  case when p_type = '{v}' then 1 else 0 end \"p_type={v}\"" for v in TYPES]) + "\nfrom part"


@query("dict_vectorize", SQL_DICT_VECTORIZE)
def q_dict_vectorize(spark, sf):
    """String columns -> ``name=value`` indicators fitted on the train
    part and applied to every row (unseen -> 0); numbers pass through."""
    p = T(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    levels = fe.one_hot_levels(p.filter(split_col("p_partkey") == "train"), ["p_brand", "p_type"])
    return fe.one_hot(p, ["p_brand", "p_type"], levels=levels, sep="=")


@query("code_split", """
select o_orderkey, o_orderpriority, substr(o_orderpriority, 1, 1) o_orderpriority_letter,
       substr(o_orderpriority, 2) o_orderpriority_number, substr(o_orderpriority, 2, 1) o_orderpriority_second
from orders""")
def q_code_split(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return (fe.code_split(o, "o_orderpriority")
            .withColumn("o_orderpriority_second", F.substring("o_orderpriority", 2, 1)))


@query("affine_ratio_features", """
with b as (select p_partkey, cast(p_size as double) ht, p_retailprice wt, p_retailprice / p_size bmi,
                  cast(p_partkey % 60 as double) age, cast(p_size % 5 as double) den from part)
select p_partkey,
  round(6.1e-3 * ht + 1.28e-2 * wt, 6) scale, round(1.2e0 * bmi + 2.3e-1 * age, 6) "Fat",
  round(ht * bmi, 6) "Ht_BMI", round(case when den = 0 then 0e0 else bmi / den end, 6) "BMI_H32",
  round(bmi * age, 6) "BMI_Age", round(wt - age, 6) "Wt_Age"
from b""")
def q_affine_ratio_features(spark, sf):
    p = T(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("ht"), F.col("p_retailprice").alias("wt"),
        (F.col("p_retailprice") / F.col("p_size")).alias("bmi"),
        (F.col("p_partkey") % 60).cast("double").alias("age"), (F.col("p_size") % 5).cast("double").alias("den"))
    f = fe.body_features(p, "ht", "wt", "bmi", "age", "den")
    return f.select("p_partkey", *[round6(x).alias(x) for x in
                                   ["scale", "Fat", "Ht_BMI", "BMI_H32", "BMI_Age", "Wt_Age"]])


@query("pair_features", """
with b as (select c_custkey, c_acctbal a, cast(c_nationkey as double) b, cast(c_custkey % 7 as double) c3,
                  cast(length(c_name) as double) c4, c_acctbal / 1e2 c5 from customer)
select c_custkey,
  round(a * b, 6) fh_1, round(a + b, 6) fh_2, round(abs(a - b), 6) fh_3,
  round(case when b = 0 then 0e0 else a / b end, 6) fh_4, round(case when a = 0 then 0e0 else b / a end, 6) fh_5,
  round(a + b + c3 + c4 + c5, 6) all_1, round(a * b * c3 * c4 * c5 / 1e6, 6) all_2
from b""")
def q_pair_features(spark, sf):
    cu = T(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"),
        (F.col("c_custkey") % 7).cast("double").alias("c3"), F.length("c_name").cast("double").alias("c4"),
        (F.col("c_acctbal") / 1e2).alias("c5"))
    f = fe.all_features(fe.pair_features(cu, "a", "b", "fh"), ["a", "b", "c3", "c4", "c5"])
    f = f.withColumn("all_2", F.col("all_2") / F.lit(1e6))  # in millions: 6 decimals stay above float noise
    return f.select("c_custkey", *[round6(x).alias(x) for x in
                                   ["fh_1", "fh_2", "fh_3", "fh_4", "fh_5", "all_1", "all_2"]])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def events_wide(spark, sf):
    """Events pivoted per user: ``n_<type>`` counts and ``v_<type>`` value sums,
    null where the user has no such event (the wide table with nulls)."""
    e = T(spark, sf, "events").select("user_id", "event_type", "value")
    levels = fe.one_hot_levels(e, ["event_type"])["event_type"]
    aggs = []
    for v in levels:
        aggs.append(F.sum(F.when(F.col("event_type") == v, 1)).cast("bigint").alias(f"n_{v}"))
        aggs.append(F.sum(F.when(F.col("event_type") == v, F.col("value"))).alias(f"v_{v}"))
    return e.groupBy("user_id").agg(*aggs)


SQL_EVENTS_WIDE = "select user_id,\n" + ",\n".join(
    f"  cast(sum(case when event_type = '{v}' then 1 end) as bigint) n_{v},"
    f" sum(case when event_type = '{v}' then value end) v_{v}" for v in EVENT_TYPES
) + "\nfrom events group by user_id"


@query("flag_counts", f"""
with w as ({SQL_EVENTS_WIDE})
select user_id, n_click + n_error + n_purchase + n_signup + n_view key_num,
       n_click + n_view count_1, n_error + n_purchase + n_signup count_2
from w""")
def q_flag_counts(spark, sf):
    """Horizontal sums of count columns (null if any part is null)."""
    w = events_wide(spark, sf)
    f = fe.count_features(w, {"key_num": [f"n_{v}" for v in EVENT_TYPES],
                              "count_1": ["n_click", "n_view"],
                              "count_2": ["n_error", "n_purchase", "n_signup"]})
    return f.select("user_id", "key_num", "count_1", "count_2")


@query("family_sums", f"""
with w as ({SQL_EVENTS_WIDE})
select user_id,
  coalesce(n_click, 0) + coalesce(n_error, 0) + coalesce(n_purchase, 0) + coalesce(n_signup, 0)
    + coalesce(n_view, 0) "fam_n_",
  round(coalesce(v_click, 0) + coalesce(v_error, 0) + coalesce(v_purchase, 0) + coalesce(v_signup, 0)
    + coalesce(v_view, 0), 6) "fam_v_"
from w""")
def q_family_sums(spark, sf):
    """Null-skipping sums of the columns whose name has a fragment."""
    w = events_wide(spark, sf)
    f = fe.family_sums(w, ["n_", "v_"])
    return f.select("user_id", F.col("fam_n_").cast("bigint").alias("fam_n_"), round6("fam_v_").alias("fam_v_"))


@query("target_encode_loo", f"""
with e as (select event_id, event_type, value, {sql_split('event_id')} split from events),
m as (select avg(value) m from e where split = 'train'),
s as (select event_type, sum(value) s, count(*) n from e where split = 'train' group by event_type)
select e.event_id, e.split, round(coalesce(
  (coalesce(s.s, m.m) - case when e.split = 'train' then e.value else 0e0 end + 1.5e1 * m.m)
  / (coalesce(s.n, 0) - case when e.split = 'train' then 1 else 0 end + 1.5e1), m.m), 6) event_type_te
from e cross join m left join s on s.event_type = e.event_type""")
def q_target_encode_loo(spark, sf):
    e = T(spark, sf, "events").select("event_id", "event_type", "value").withColumn("split", split_col("event_id"))
    t = fe.target_encode_loo(e, "event_type", "value", F.col("split") == "train")
    return t.select("event_id", "split", round6("event_type_te").alias("event_type_te"))


@query("target_encode_orders", f"""
with e as (select o_orderkey, o_orderpriority, o_totalprice / 1e3 y, {sql_split('o_orderkey')} split from orders),
m as (select avg(y) m from e where split = 'train'),
s as (select o_orderpriority, sum(y) s, count(*) n from e where split = 'train' group by o_orderpriority)
select e.o_orderkey, round(coalesce(
  (coalesce(s.s, m.m) - case when e.split = 'train' then e.y else 0e0 end + 1.5e1 * m.m)
  / (coalesce(s.n, 0) - case when e.split = 'train' then 1 else 0 end + 1.5e1), m.m), 6) o_orderpriority_te
from e cross join m left join s on s.o_orderpriority = e.o_orderpriority""")
def q_target_encode_orders(spark, sf):
    """E11 on orders: priority encoded by the mean order price (in thousands)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 1e3).alias("y"))
    t = fe.target_encode_loo(o.withColumn("split", split_col("o_orderkey")), "o_orderpriority", "y",
                             F.col("split") == "train")
    return t.select("o_orderkey", round6("o_orderpriority_te").alias("o_orderpriority_te"))


@query("woe_encode", f"""
with dl as ({SQL_DOCS_LABELLED}),
g as (select lang, cast(sum(case when quality > 0 then 1 else 0 end) as bigint) n1,
             cast(sum(case when quality > 0 then 0 else 1 end) as bigint) n0
      from dl where quality is not null group by lang)
select lang, n1, n0, round(ln(((n1 + 5e-1) / sum(n1 + 5e-1) over ()) / ((n0 + 5e-1) / sum(n0 + 5e-1) over ())), 6) lang_woe
from g""")
def q_woe_encode(spark, sf):
    w = fe.woe_encode(docs_labelled(spark, sf), "lang", "quality")
    return w.select("lang", F.col("n1").cast("bigint").alias("n1"), F.col("n0").cast("bigint").alias("n0"),
                    round6("lang_woe").alias("lang_woe"))


@query("standardize_pop", f"""
with o as (select o_orderkey, o_totalprice x, {sql_split('o_orderkey')} split from orders),
m as (select avg(x) m, stddev_pop(x) s from o where split = 'train')
select o_orderkey, split, round((x - m) / nullif(s, 0e0), 6) z from o, m""")
def q_standardize_pop(spark, sf):
    """Population-std scaling fitted on train rows, applied to all."""
    o = T(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")) \
        .withColumn("split", split_col("o_orderkey"))
    z = fe.standardize(o, ["x"], fit_on=F.col("split") == "train", suffix="_z")
    return z.select("o_orderkey", "split", round6("x_z").alias("z"))


@query("standardize_by_batch", """
with o as (select o_orderkey, o_totalprice x,
                  cast(floor((row_number() over (order by o_orderkey) - 1) / 1000) as bigint) batch from orders)
select o_orderkey, batch,
  round((x - avg(x) over (partition by batch)) / nullif(stddev_pop(x) over (partition by batch), 0e0), 6) z
from o""")
def q_standardize_by_batch(spark, sf):
    """Consecutive batches of 1000 rows by key order, scaled per batch."""
    o = T(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    b = batches(o, ["o_orderkey"], 1000)
    z = fe.standardize(b, ["x"], by=["batch"], suffix="_z")
    return z.select("o_orderkey", "batch", round6("x_z").alias("z"))


# fixed values: the reference blends its three closed-form scores with these weights
BLEND = {"p1": 0.32018, "p2": 0.35505}
OFFSET = 4.5
EXPR_SPARK = {
    "p1": "sin(p_retailprice / 1e2) + cos(p_size) * 5e-1 + tanh(p_size / 1e1)",
    "p2": "floor(p_retailprice / 1e2) + ceil(p_size / 7e0) - bround(p_size / 4e0, 0) + sqrt(p_size) + ln(p_retailprice)",
    "p3": "greatest(p_size / 1e1, sinh(p_retailprice / 2e3)) - least(cosh(p_size / 5e1), exp(p_size / 1e2))"
          " + pow(p_size, 5e-1) * sign(p_retailprice - 1.5e3) + round(p_size / 4e0, 0)",
}


@query("expression_scores", """
with s as (select p_partkey,
  sin(p_retailprice / 1e2) + cos(p_size) * 5e-1 + tanh(p_size / 1e1) + 4.5e0 p1,
  floor(p_retailprice / 1e2) + ceil(p_size / 7e0) - round_even(p_size / 4e0, 0) + sqrt(p_size) + ln(p_retailprice) + 4.5e0 p2,
  greatest(p_size / 1e1, sinh(p_retailprice / 2e3)) - least(cosh(p_size / 5e1), exp(p_size / 1e2))
    + pow(p_size, 5e-1) * sign(p_retailprice - 1.5e3) + round(p_size / 4e0, 0) + 4.5e0 p3
  from part)
select p_partkey, round(p1, 6) p1, round(p2, 6) p2, round(p3, 6) p3,
       round(p3 + 3.2018e-1 * (p1 - p3) + 3.5505e-1 * (p2 - p3), 6) score
from s""")
def q_expression_scores(spark, sf):
    """E15 with F4-F10: three closed-form scores, offset 4.5, blended."""
    p = T(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    s = fe.expression_scores(p, EXPR_SPARK, offset=OFFSET, blend=BLEND)
    return s.select("p_partkey", *[round6(x).alias(x) for x in ["p1", "p2", "p3", "score"]])
