"""Folds, class distributions, decoders and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import expected_class, round6, sigmoid, softmax
from ordlab.operators import decode as dc
from ordlab.operators import metrics as mt
from ordlab.operators.profile import class_cdf, mean_cdf_pdf
from ordlab.operators.rank import ordered_split, position
from ordlab.operators.split import fold_metadata, fold_table, holdout
from ordlab.plans.catalog import T, query
from ordlab.plans.standins import (SQL_DOCS_LABELLED, SQL_ORDERS_BASE, SQL_PART_SCORES, SQL_SPLIT_KEY,
                                   docs_labelled, orders_scored, part_scores)
from ordlab.session import dealt, fitted

OB = f"with ob as ({SQL_ORDERS_BASE})"
FOLDS_SQL = f"""folds as (select r.run, ob.id, ob.y, ob.score,
  case when {SQL_SPLIT_KEY.format(run='r.run', id='ob.id')} < 2000 then 'test' else 'train' end role
  from ob, (select cast(unnest(generate_series(1, 6)) as integer) run) r)"""

# fixed cut points for the cut decoders (right-closed bins)
CUTS = [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]
CUTS3 = (2.0, 3.0, 4.0)
SQL_CUT_CLASS = "(1 + " + " + ".join(f"case when score > {c}e0 then 1 else 0 end" for c in CUTS) + ")"


@query("cv_folds", f"""{OB}, {FOLDS_SQL}
select run, id, role from folds""")
def q_cv_folds(spark, sf):
    """H1 stored form: six seeded 80/20 holdouts as ``(run, id, role)``."""
    return fold_table(orders_scored(spark, sf).select("id"), "id", runs=6, test_fraction=0.2)


@query("fold_cdf", f"""{OB}, {FOLDS_SQL},
h as (select run, y cls, count(*) c from folds where role = 'train' group by run, y),
sz as (select run, count(*) filter (where role = 'train') n_train, count(*) filter (where role = 'test') n_test
       from folds group by run)
select h.run, cast(h.cls as integer) cls, cast(h.c as bigint) cnt,
  round(h.c / cast(sum(h.c) over (partition by h.run) as double), 6) pdf,
  round(sum(h.c) over (partition by h.run order by h.cls rows unbounded preceding)
        / cast(sum(h.c) over (partition by h.run) as double), 6) cdf,
  sz.n_train, sz.n_test
from h join sz on sz.run = h.run""")
def q_fold_cdf(spark, sf):
    """H4: per run, the group sizes and the class CDF of the train part."""
    folds = holdout(orders_scored(spark, sf).select("id", "y"), "id", runs=6, test_fraction=0.2)
    sizes, cdf = fold_metadata(folds, "y")
    wide = sizes.groupBy("run").agg(F.sum(F.when(F.col("role") == "train", F.col("n"))).alias("n_train"),
                                    F.sum(F.when(F.col("role") == "test", F.col("n"))).alias("n_test"))
    return cdf.join(wide, "run").select("run", "cls", "cnt", round6("pdf").alias("pdf"), round6("cdf").alias("cdf"),
                                        "n_train", "n_test")


@query("ordered_split", """
select o_orderkey,
  case when row_number() over (order by o_orderdate, o_orderkey) - 1 < floor(count(*) over () * 8e-1)
       then 'train' else 'test' end role
from orders""")
def q_ordered_split(spark, sf):
    """The first 80 % of rows in date order train, the rest test."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ordered_split(o, ["o_orderdate", "o_orderkey"], 0.8).select("o_orderkey", "role")


@query("class_hist_cdf", f"""{OB},
h as (select y cls, count(*) c from ob group by y)
select cast(cls as integer) cls, cast(c as bigint) cnt, round(c / cast(sum(c) over () as double), 6) pdf,
  round(sum(c) over (order by cls rows unbounded preceding) / cast(sum(c) over () as double), 6) cdf
from h""")
def q_class_hist_cdf(spark, sf):
    """Zero-filled class histogram, share and cumulative share."""
    c = class_cdf(orders_scored(spark, sf), "y")
    return c.select("cls", "cnt", round6("pdf").alias("pdf"), round6("cdf").alias("cdf"))


@query("mean_cdf_pdf", f"""{OB}, {FOLDS_SQL},
h as (select run, y cls, count(*) c from folds where role = 'train' group by run, y),
c as (select run, cls, sum(c) over (partition by run order by cls rows unbounded preceding)
             / cast(sum(c) over (partition by run) as double) cdf from h),
m as (select cls, avg(cdf) cdf from c group by cls)
select cast(cls as integer) cls, round(cdf, 6) cdf, round(cdf - coalesce(lag(cdf) over (order by cls), 0e0), 6) pdf
from m""")
def q_mean_cdf_pdf(spark, sf):
    """Fold CDFs averaged over runs and differenced back to a PDF."""
    folds = holdout(orders_scored(spark, sf).select("id", "y"), "id", runs=6, test_fraction=0.2)
    cdfs = class_cdf(folds.filter(F.col("role") == "train"), "y", by=["run"])
    m = mean_cdf_pdf(cdfs, over="run")
    return m.select("cls", round6("cdf").alias("cdf"), round6("pdf").alias("pdf"))


@query("rank_score", f"""{OB}
select id, round(score, 6) score, row_number() over (order by score, id) - 1 rank from ob""")
def q_rank_score(spark, sf):
    """0-based rank of the score (ties by id), without a single-task window."""
    p = position(orders_scored(spark, sf).select("id", "score"), ["score", "id"], "rank")
    return p.select("id", round6("score").alias("score"), "rank")


SQL_DECODE_CDF_TAIL = """
h as (select y, count(*) c from b group by y),
cdf as (select y, sum(c) over (order by y rows unbounded preceding) / cast(sum(c) over () as double) f from h),
g as (select y, f, coalesce(lag(f) over (order by y), 0e0) pf from cdf),
r as (select id, y, row_number() over (order by s, id) - 1 r, count(*) over () n from b)
select r.id, r.y, cast(coalesce(g.y, 8) as integer) cls
from r left join g on g.y < 8
 and r.r >= (case when g.y = 1 then 0 else floor(r.n * g.pf) end)
 and r.r < floor(greatest(r.n * g.f - 1, 0e0))"""


@query("decode_cdf", """
with b as (select o_orderkey id, o_totalprice / 6.25e4 s, cast((o_custkey % 8) + 1 as integer) y from orders),
""" + SQL_DECODE_CDF_TAIL)
def q_decode_cdf(spark, sf):
    """D1 (strict, Q1) with the label CDF of the same rows."""
    o = orders_scored(spark, sf).select("id", "y", "score")
    cdf = class_cdf(o, "y")
    return dc.decode_cdf(o, "score", "id", cdf, out="cls").select("id", "y", "cls")


@query("decode_cut", f"""{OB}
select id, cast({SQL_CUT_CLASS} as integer) cls from ob""")
def q_decode_cut(spark, sf):
    o = orders_scored(spark, sf)
    return o.select("id", dc.decode_cut("score", CUTS).alias("cls"))


@query("decode_cut3", f"""{OB}
select id, cast(case when score <= {CUTS3[0]}e0 then 1 when score <= {CUTS3[1]}e0 then 2
                     when score <= {CUTS3[2]}e0 then 3 else 4 end as integer) cls from ob""")
def q_decode_cut3(spark, sf):
    o = orders_scored(spark, sf)
    return o.select("id", dc.decode_cut3("score", CUTS3).alias("cls"))


@query("decode_expected", f"""
with ps as ({SQL_PART_SCORES}),
sm as (select id, y, list_transform(s, lambda x: exp(x - list_max(s))) e from ps),
pr as (select id, y, list_transform(e, lambda x: x / list_sum(e)) p from sm),
b as (select id, y, list_sum(list_transform(generate_series(1, 8), lambda k: p[k] * k)) s from pr),
""" + SQL_DECODE_CDF_TAIL)
def q_decode_expected(spark, sf):
    """D4 with F11/F20: softmax of eight class scores, expected class, CDF decode."""
    p = part_scores(spark, sf).withColumn("p", softmax("s", 8))
    cdf = class_cdf(p, "y")
    return dc.decode_expected(p, "p", "id", cdf, out="cls").select("id", "y", "cls")


@query("decode_ebc", f"""
with ps as ({SQL_PART_SCORES}),
p as (select id, list_transform(s, lambda x: 1e0 / (1e0 + exp(-x))) p, s from ps)
select id, round(1e0 + list_sum(p[1:7]), 6) ebc_soft,
       cast(1 + len(list_filter(s[1:7], lambda x: x > 0)) as integer) ebc_hard from p""")
def q_decode_ebc(spark, sf):
    """Soft and hard extended-binary decodes of the first seven outputs."""
    p = part_scores(spark, sf).withColumn("p", F.transform("s", lambda x: sigmoid(x)))
    return p.select("id", round6(dc.decode_ebc("p")).alias("ebc_soft"),
                    dc.decode_ebc("s", hard=True).alias("ebc_hard"))


@query("decode_cocr", f"""
with ps as ({SQL_PART_SCORES})
select id, round(1e0 + list_sum(list_transform(s, lambda x: 1e0 / (1e0 + exp(-x)))), 6) cocr from ps""")
def q_decode_cocr(spark, sf):
    """``1 + sum_k p_k`` over all eight outputs."""
    p = part_scores(spark, sf).withColumn("p", F.transform("s", lambda x: sigmoid(x)))
    return p.select("id", round6(dc.decode_cocr("p")).alias("cocr"))


@query("decode_round", f"""{OB},
r as (select id, score, cast(trunc(round(score, 0)) as bigint) rr from ob)
select id, cast(case when score < 1 then 1 when score > 8 then 8 when rr = 3 then 2 else rr end as integer) cls
from r""")
def q_decode_round(spark, sf):
    """Clamp to 1..8, half-away rounding, a rounded 3 becomes 2."""
    o = orders_scored(spark, sf)
    return o.select("id", dc.decode_round("score").alias("cls"))


@query("cutpoints_mean", f"""{OB}, {FOLDS_SQL},
m as (select run, y, avg(score) ms from folds where role = 'train' group by run, y),
c as (select a.run, a.y k, (a.ms + b.ms) / 2e0 cut from m a join m b on b.run = a.run and b.y = a.y + 1)
select cast(k as integer) k, round(avg(cut), 6) cut from c group by k""")
def q_cutpoints_mean(spark, sf):
    """Per run, cut k is the midpoint of the mean train scores of classes
    k and k+1; the cuts are then averaged over the six runs."""
    folds = holdout(orders_scored(spark, sf).select("id", "y", "score"), "id", runs=6, test_fraction=0.2)
    m = folds.filter(F.col("role") == "train").groupBy("run", "y").agg(F.avg("score").alias("ms"))
    nxt = m.select("run", (F.col("y") - 1).alias("y"), F.col("ms").alias("ms2"))
    cuts = m.join(nxt, ["run", "y"]).select("run", F.col("y").alias("k"),
                                            ((F.col("ms") + F.col("ms2")) / 2.0).alias("cut"))
    return dc.cutpoints_mean(cuts).select("k", round6("cut").alias("cut"))


def orders_cut(spark, sf):
    o = orders_scored(spark, sf)
    return o.withColumn("cls", dc.decode_cut("score", CUTS))


CUTQ = f"{OB}, oc as (select id, y, score, o_orderstatus, o_totalprice, cast({SQL_CUT_CLASS} as integer) cls from ob)"


@query("confusion", f"""{CUTQ},
rg as (select least(min(y), min(cls)) lo, greatest(max(y), max(cls)) hi from oc),
grid as (select a.a, b.b from rg, (select unnest(generate_series(1, 8)) a) a, (select unnest(generate_series(1, 8)) b) b
         where a.a between rg.lo and rg.hi and b.b between rg.lo and rg.hi),
cnt as (select y a, cls b, count(*) n from oc group by y, cls)
select cast(grid.a as integer) a, cast(grid.b as integer) b, cast(coalesce(cnt.n, 0) as bigint) n
from grid left join cnt on cnt.a = grid.a and cnt.b = grid.b""")
def q_confusion(spark, sf):
    """Dense confusion matrix of label vs cut-decoded class."""
    return mt.confusion(orders_cut(spark, sf), "y", "cls")


@query("error_pairs", f"""{CUTQ}
select cast(y as varchar) || ':' || cast(cls as varchar) "key", count(*) value from oc where y <> cls
group by 1""")
def q_error_pairs(spark, sf):
    """``raw:pred`` counts over mismatching rows."""
    return mt.error_pairs(orders_cut(spark, sf), "y", "cls")


@query("rating_hist", f"""{CUTQ},
g as (select unnest(generate_series(1, 8)) rating),
c as (select cls rating, count(*) n from oc group by cls)
select cast(g.rating as integer) rating, cast(coalesce(c.n, 0) as bigint) n from g left join c on c.rating = g.rating""")
def q_rating_hist(spark, sf):
    """M2: zero-filled histogram of the decoded class over 1..8."""
    return mt.rating_hist(orders_cut(spark, sf), "cls", lo=1, hi=8)


SQL_QWK_BY = """
select o_orderstatus, round(1 - sum((y - cls) * (y - cls))
  / nullif(count(*) * (var_pop(y) + var_pop(cls) + (avg(y) - avg(cls)) ^ 2), 0), 6) kappa
from oc group by o_orderstatus"""


@query("qwk", CUTQ + SQL_QWK_BY)
def q_qwk(spark, sf):
    """M3 per order status."""
    k = mt.qwk(orders_cut(spark, sf), "y", "cls", by=["o_orderstatus"])
    return k.select("o_orderstatus", round6("kappa").alias("kappa"))


@query("linear_kappa", f"""{CUTQ},
ha as (select o_orderstatus g, y v, count(*) c from oc group by 1, 2),
hb as (select o_orderstatus g, cls v, count(*) c from oc group by 1, 2),
e as (select ha.g, sum(ha.c * hb.c * abs(ha.v - hb.v)) / sum(ha.c * hb.c) * 1e0 ed from ha join hb on hb.g = ha.g group by ha.g),
n as (select o_orderstatus g, sum(abs(y - cls)) o, count(*) n from oc group by 1)
select n.g o_orderstatus, round(1 - (n.o / cast(n.n as double)) / nullif(e.ed, 0), 6) kappa
from n join e on e.g = n.g""")
def q_linear_kappa(spark, sf):
    """M4 per order status."""
    k = mt.linear_kappa(orders_cut(spark, sf), "y", "cls", by=["o_orderstatus"])
    return k.select("o_orderstatus", round6("kappa").alias("kappa"))


@query("cohen_kappa", f"""{CUTQ},
ha as (select o_orderstatus g, y v, count(*) c from oc group by 1, 2),
hb as (select o_orderstatus g, cls v, count(*) c from oc group by 1, 2),
m as (select ha.g, sum(ha.c * hb.c) m from ha join hb on hb.g = ha.g and hb.v = ha.v group by ha.g),
n as (select o_orderstatus g, sum(case when y <> cls then 1e0 else 0e0 end) o, count(*) n from oc group by 1)
select n.g o_orderstatus, round(1 - n.o / nullif(n.n - coalesce(m.m, 0) / cast(n.n as double), 0), 6) kappa
from n left join m on m.g = n.g""")
def q_cohen_kappa(spark, sf):
    """M5 per order status."""
    k = mt.cohen_kappa(orders_cut(spark, sf), "y", "cls", by=["o_orderstatus"])
    return k.select("o_orderstatus", round6("kappa").alias("kappa"))


@query("mean_kappa_z", f"""{CUTQ},
k as ({SQL_QWK_BY.replace('round(', '(', 1).replace(', 6) kappa', ') kappa', 1)}),
w as (select o_orderstatus, count(*) * 1e0 w from oc group by 1),
z as (select 5e-1 * ln((1 + least(greatest(kappa, -9.99e-1), 9.99e-1)) / (1 - least(greatest(kappa, -9.99e-1), 9.99e-1)))
             * (w.w / avg(w.w) over ()) z from k join w using (o_orderstatus))
select round(tanh(avg(z)), 6) mean_kappa from z""")
def q_mean_kappa_z(spark, sf):
    """M6: Fisher-z mean of the per-status kappas weighted by row counts."""
    oc = orders_cut(spark, sf)
    k = mt.qwk(oc, "y", "cls", by=["o_orderstatus"])
    w = oc.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("w"))
    m = mt.mean_kappa_z(k.join(w, "o_orderstatus"), "kappa", weight="w")
    return m.select(round6("mean_kappa").alias("mean_kappa"))


@query("grouped_weighted_kappa", f"""{OB},
truth as (select id, o_orderstatus essay_set, y essay_score,
                 avg(o_totalprice) over (partition by o_orderstatus) / 1e5 essay_weight from ob),
pred as (select id, cast({SQL_CUT_CLASS} as integer) predicted_score from ob),
j as (select t.*, p.predicted_score from truth t left join pred p on p.id = t.id),
k as (select essay_set, min(essay_weight) w, 1 - sum((essay_score - predicted_score) * (essay_score - predicted_score))
        / nullif(count(*) * (var_pop(essay_score) + var_pop(predicted_score)
                 + (avg(essay_score) - avg(predicted_score)) ^ 2), 0) kappa from j group by essay_set),
z as (select 5e-1 * ln((1 + least(greatest(kappa, -9.99e-1), 9.99e-1)) / (1 - least(greatest(kappa, -9.99e-1), 9.99e-1)))
             * (w / avg(w) over ()) z from k)
select round(tanh(avg(z)), 6) mean_kappa from z""")
def q_grouped_weighted_kappa(spark, sf):
    """Truth LEFT JOIN predictions on id, QWK per group, group weight
    taken from the group's rows, Fisher-z weighted mean."""
    o = orders_scored(spark, sf)
    # pinned, so that its size is known: a join of unknown size would be dealt by the few statuses
    wt = fitted(o.groupBy("o_orderstatus").agg((F.avg("o_totalprice") / 1e5).alias("essay_weight")))
    truth = o.select("id", F.col("o_orderstatus").alias("essay_set"), F.col("y").alias("essay_score"),
                     "o_orderstatus").join(wt, "o_orderstatus").drop("o_orderstatus")
    pred = o.select("id", dc.decode_cut("score", CUTS).alias("predicted_score"))
    # tasks of a bounded number of rows: left to adaptive coalescing, a task would sort what it is given at once
    j = dealt(truth, "id", 1 << 18).join(dealt(pred, "id", 1 << 18), "id", "left")
    k = mt.qwk(j, "essay_score", "predicted_score", by=["essay_set"])
    w = j.groupBy("essay_set").agg(F.min("essay_weight").alias("w"))
    m = mt.mean_kappa_z(k.join(w, "essay_set"), "kappa", weight="w")
    return m.select(round6("mean_kappa").alias("mean_kappa"))


@query("accuracy", f"""{OB},
r as (select id, y, score, o_orderstatus, cast(trunc(round(score, 0)) as bigint) rr from ob),
d as (select *, case when score < 1 then 1 when score > 8 then 8 when rr = 3 then 2 else rr end cls from r)
select o_orderstatus, round(avg(case when y = cls then 1e0 else 0e0 end), 6) accuracy from d group by 1""")
def q_accuracy(spark, sf):
    """M8 of the round decode per status."""
    o = orders_scored(spark, sf).withColumn("cls", dc.decode_round("score"))
    a = mt.accuracy(o, "y", "cls", by=["o_orderstatus"])
    return a.select("o_orderstatus", round6("accuracy").alias("accuracy"))


@query("rmse_mae_ev", f"""{OB}
select o_orderstatus, round(sqrt(avg((score - y) * (score - y))), 6) rmse, round(avg((score - y) * (score - y)), 6) mse,
  round(avg(abs(score - y)), 6) mae, round(1 - var_pop(y - score) / nullif(var_pop(y), 0), 6) explained_variance
from ob group by 1""")
def q_rmse_mae_ev(spark, sf):
    """M9-M11 per status."""
    e = mt.regression_errors(orders_scored(spark, sf), "y", "score", by=["o_orderstatus"])
    return e.select("o_orderstatus", *[round6(x).alias(x) for x in ["rmse", "mse", "mae", "explained_variance"]])


DOC_P = "1e0 / (1e0 + exp(-(ln(n_chars) - 7e0)))"


@query("logloss", f"""with dl as ({SQL_DOCS_LABELLED}),
p as (select lang, quality y, least(greatest({DOC_P}, 1e-15), 1 - 1e-15) p from dl where quality is not null)
select lang, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) logloss from p group by lang""")
def q_logloss(spark, sf):
    """A length-based probability against the quality label, per language."""
    d = docs_labelled(spark, sf).filter(F.col("quality").isNotNull()) \
        .withColumn("p", sigmoid(F.ln("n_chars") - F.lit(7.0)))
    return mt.logloss(d, "quality", "p", by=["lang"]).select("lang", round6("logloss").alias("logloss"))


@query("auc", f"""with dl as ({SQL_DOCS_LABELLED}),
p as (select lang, doc_id, case when quality > 0 then 1 else 0 end y, {DOC_P} p from dl where quality is not null),
r as (select lang, y, (rank() over (partition by lang order by p) + count(*) over (partition by lang, p) - 1
                       + rank() over (partition by lang order by p)) / 2e0 rk from p),
g as (select lang, sum(case when y = 1 then rk else 0 end) rs, sum(y) np, count(*) n from r group by lang)
select lang, round((rs - np * (np + 1) / 2e0) / nullif(np * (n - np), 0), 6) auc from g""")
def q_auc(spark, sf):
    """Exact tie-averaged rank-sum AUC per language."""
    d = docs_labelled(spark, sf).filter(F.col("quality").isNotNull()) \
        .withColumn("p", sigmoid(F.ln("n_chars") - F.lit(7.0)))
    return mt.auc(d, "quality", "p", "doc_id", by=["lang"]).select("lang", round6("auc").alias("auc"))
