"""Objectives, votes, blends, cut-point search and ensemble queries
(G1 G2 G3 G5 N1-N8 A17 T2 X1 X2 M15 J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import bagging as bg
from ordlab.operators import cutpoints as cp
from ordlab.operators import decode as dc
from ordlab.operators import ensemble as en
from ordlab.operators import objectives as ob
from ordlab.operators.profile import class_cdf, mean_cdf_pdf
from ordlab.operators.split import holdout, split_key
from ordlab.plans.catalog import T, query
from ordlab.plans.standins import (SQL_ORDERS_BASE, SQL_PART_SCORES, SQL_SPLIT_KEY, orders_scored,
                                   part_scores)
from ordlab.session import fitted, materialize

PS = f"with ps as ({SQL_PART_SCORES})"
KS = "(select unnest(generate_series(1, 8)) k) kk"


def _obj_out(df):
    return df.select("id", "k", round6("grad").alias("grad"), round6("hess").alias("hess"))


@query("objective_ebc", f"""{PS},
e as (select id, cast(y as double) y, kk.k, s[kk.k] sk, case when y > kk.k then 1e0 else -1e0 end b from ps, {KS}),
w as (select *, abs((b - k) * (b - k) - (b - k - 1) * (b - k - 1)) w, exp(b * sk) t from e)
select id, cast(k as integer) k,
  round(case when k < 8 then -1e0 * w * b / (1e0 + t) else 0e0 end, 6) grad,
  round(case when k < 8 then 1e0 * w * b * b * t / ((1e0 + t) * (1e0 + t)) else 0e0 end, 6) hess
from w""")
def q_objective_ebc(spark, sf):
    """G1 with the reference cost (Q3) on eight class scores of part."""
    p = part_scores(spark, sf)
    return _obj_out(ob.ebc(p, "id", "y", "s"))


@query("objective_cocr", f"""{PS},
e as (select id, cast(y as double) y, kk.k, s[kk.k] sk from ps, {KS})
select id, cast(k as integer) k,
  round(2e0 * 1e0 * abs((y - k) * (y - k) - (y - k + 1) * (y - k + 1)) * (sk - case when y >= k then 1e0 else 0e0 end), 6) grad,
  round(2e0 * 1e0 * abs((y - k) * (y - k) - (y - k + 1) * (y - k + 1)), 6) hess
from e""")
def q_objective_cocr(spark, sf):
    """G2 on eight class scores of part."""
    return _obj_out(ob.cocr(part_scores(spark, sf), "id", "y", "s"))


@query("objective_softkappa", f"""{PS},
sm as (select id, cast(y as double) y, list_transform(s, lambda x: exp(x - list_max(s))) e from ps),
pr as (select id, y, list_transform(e, lambda x: x / list_sum(e)) p from sm),
gl as (select count(*) * 1e0 mm, 2e0 * (count(*) * sum(y * y) - sum(y) * sum(y)) ee from pr),
m as (select id, y, p, list_sum(list_transform(generate_series(1, 8), lambda j: (y - j) * (y - j) * p[j])) m from pr),
lg as (select id, y, m, kk.k, p[kk.k] pn from m, {KS}),
q as (select id, k, 1e0 * gl.mm * (pn * ((y - k) * (y - k) - m)) / gl.ee grad,
             gl.mm * pn * (1e0 - 2e0 * pn) * ((y - k) * (y - k) - m) / gl.ee q from lg, gl)
select id, cast(k as integer) k, round(grad * 1e6, 6) grad_e6, round(1e0 * abs(q) * 1e0 / avg(abs(q)) over (), 6) hess
from q""")
def q_objective_softkappa(spark, sf):
    """G3 (label histogram on both sides); gradient reported times 1e6 and
    hess_scale 1 so that six decimals keep the digits."""
    o = ob.softkappa(part_scores(spark, sf), "id", "y", "s", hess_scale=1.0)
    return o.select("id", "k", round6(F.col("grad") * F.lit(1e6)).alias("grad_e6"), round6("hess").alias("hess"))


@query("objective_pseudo_huber", f"""with ob as ({SQL_ORDERS_BASE})
select id, round((score - y) / sqrt(8.1e-1 + (score - y) * (score - y)), 6) grad,
       round(8.1e-1 * pow(8.1e-1 + (score - y) * (score - y), -1.5e0), 6) hess from ob""")
def q_objective_pseudo_huber(spark, sf):
    """G5 with gamma 0.9 on the order score against the label."""
    o = ob.pseudo_huber(orders_scored(spark, sf), "id", "y", "score", gamma=0.9)
    return o.select("id", round6("grad").alias("grad"), round6("hess").alias("hess"))


CUTS = [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]
SQL_C1 = "(1 + " + " + ".join(f"case when score > {c}e0 then 1 else 0 end" for c in CUTS) + ")"
SQL_C2 = ("(case when score < 1 then 1 when score > 8 then 8 when trunc(round(score, 0)) = 3 then 2 "
          "else cast(trunc(round(score, 0)) as integer) end)")
SQL_C3 = "(case when score <= 2e0 then 1 when score <= 3e0 then 2 when score <= 4e0 then 3 else 4 end)"
VOTES = f"with ob as ({SQL_ORDERS_BASE}), v as (select id, {SQL_C1} c1, {SQL_C2} c2, {SQL_C3} c3 from ob)"


def _votes(spark, sf):
    o = orders_scored(spark, sf)
    return o.select("id", dc.decode_cut("score", CUTS).alias("c1"), dc.decode_round("score").alias("c2"),
                    dc.decode_cut3("score", (2.0, 3.0, 4.0)).alias("c3"))


@query("vote_majority", VOTES + """
select id, cast(case when c1 = c2 or c1 = c3 then c1 when c2 = c3 then c2 else least(c1, c2, c3) end as integer) vote
from v""")
def q_vote_majority(spark, sf):
    """Row-wise mode of three decoders, lowest class on ties."""
    return _votes(spark, sf).select("id", en.vote_majority(["c1", "c2", "c3"]).cast("int").alias("vote"))


@query("vote_agreement", VOTES + """
select id, cast(case when c1 = c2 or c1 = c3 then c1 when c2 = c3 then c2 else c1 end as integer) vote from v""")
def q_vote_agreement(spark, sf):
    """Class with at least two of three votes, else the first model's."""
    return _votes(spark, sf).select("id", en.vote_agreement("c1", "c2", "c3").cast("int").alias("vote"))


# fixed model weights of the blend query
BLEND_W = {"m1": 0.5, "m2": 0.3, "m3": 0.2}
SQL_MODELS = """
models as (
  select o_orderkey id, 'm1' model, o_totalprice / 6.25e4 prediction from orders union all
  select o_orderkey, 'm2', o_totalprice / 6.25e4 + cast(substr(o_orderpriority, 1, 1) as double) * 2.5e-1 from orders union all
  select o_orderkey, 'm3', (o_custkey % 97) / 1.2e1 from orders union all
  select o_orderkey, 'm4', cast((o_custkey % 8) + 1 as double) + 3e0 * sin(o_orderkey) from orders)"""


def model_preds(spark, sf):
    """Long predictions of four formula models on orders: ``(model, id, prediction)``."""
    o = _with_models(T(spark, sf, "orders"))
    return o.select(F.col("o_orderkey").alias("id"), "target", "m.model", "m.prediction")


def _with_models(o):
    """Order rows, one per model, with the label and the model's prediction."""
    m = F.explode(F.array(
        F.struct(F.lit("m1").alias("model"), (F.col("o_totalprice") / 6.25e4).alias("prediction")),
        F.struct(F.lit("m2").alias("model"), (F.col("o_totalprice") / 6.25e4
                                              + F.substring("o_orderpriority", 1, 1).cast("double") * 0.25)
                 .alias("prediction")),
        F.struct(F.lit("m3").alias("model"), ((F.col("o_custkey") % 97) / 12.0).alias("prediction")),
        F.struct(F.lit("m4").alias("model"), (((F.col("o_custkey") % 8) + 1).cast("double")
                                              + 3.0 * F.sin("o_orderkey")).alias("prediction"))))
    return o.select("*", ((F.col("o_custkey") % 8) + 1).cast("int").alias("target"), m.alias("m"))


@query("blend_weighted", f"""with {SQL_MODELS.strip()},
w as (select * from (values ('m1', 5e-1), ('m2', 3e-1), ('m3', 2e-1)) t(model, weight))
select id, round(sum(weight * prediction) / sum(weight), 6) blend from models join w using (model) group by id""")
def q_blend_weighted(spark, sf):
    """Weighted blend of three models' predictions."""
    w = spark.createDataFrame(list(BLEND_W.items()), "model string, weight double")
    b = en.blend_weighted(model_preds(spark, sf), w)
    return b.select("id", round6("blend").alias("blend"))


@query("bag_average", f"""with ob as ({SQL_ORDERS_BASE}),
b as (select ob.id, g.bag, ob.score * (1e0 + 1e-2 * g.bag) + 1e-1 * ({SQL_SPLIT_KEY.format(run='g.bag', id='ob.id')}) / 1e4 p
      from ob, (select unnest(generate_series(1, 5)) bag) g)
select id, round(avg(p), 6) avg from b group by id""")
def q_bag_average(spark, sf):
    """Five bagged predictions averaged per row."""
    o = orders_scored(spark, sf).select("id", "score")
    b = o.withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(5))))
    b = b.withColumn("prediction", F.col("score") * (F.lit(1.0) + F.lit(0.01) * F.col("bag"))
                     + F.lit(0.1) * split_key("id", F.col("bag")) / F.lit(1e4))
    return en.bag_average(b).select("id", round6("avg").alias("avg"))


GRID_A = [-0.5, -0.25, 0.0, 0.25, 0.5]
GRID_B = [0.8, 0.9, 1.0, 1.1, 1.2]
CANDS = [[a + b * (k + 0.5) for k in range(1, 8)] for a in GRID_A for b in GRID_B]


def _sql_cands():
    rows = []
    for ci, cuts in enumerate(CANDS):
        rows.append(f"({ci}, " + ", ".join(f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in cuts) + ")")
    cols = ", ".join(f"c{k}" for k in range(1, 8))
    return f"(select * from (values {', '.join(rows)}) t(cand, {cols}))"


SQL_CUTPOINT_GRID = f"""with ob as ({SQL_ORDERS_BASE}),
cd as {_sql_cands()},
d as (select cd.cand, ob.y, 1 + """ + " + ".join(f"case when ob.score > cd.c{k} then 1 else 0 end" for k in range(1, 8)) + """ cls
      from ob, cd)
select cast(cand as integer) cand, round(1 - sum((y - cls) * (y - cls))
  / nullif(count(*) * (var_pop(y) + var_pop(cls) + (avg(y) - avg(cls)) ^ 2), 0), 6) kappa
from d group by cand"""


@query("cutpoint_search_grid", SQL_CUTPOINT_GRID)
def q_cutpoint_search_grid(spark, sf):
    """QWK of every cut vector of a fixed 25-candidate table,
    evaluated from one interval histogram of the rows."""
    o = orders_scored(spark, sf).select("score", "y")
    k = cp.score_candidates(o, "score", "y", CANDS)
    return k.select("cand", round6("kappa").alias("kappa"))


# grid of the exact search over all cut triples; the value below it stands for an empty first class
TRIPLE_GRID = [0.5 * j for j in range(1, 16)]
SQL_LABEL4 = "cast(1 + least(greatest(floor(o_totalprice / 1.25e5 + ((o_custkey % 5) - 2) / 2.5e0), 0), 3) as integer)"
SQL_CUTPOINT_TRIPLES = f"""with ob as (select o_totalprice / 6.25e4 score, {SQL_LABEL4} y from orders),
g as (select unnest([-5e-1, {', '.join(f'{v}e0' for v in TRIPLE_GRID)}]) v),
cd as (select a.v c1, b.v c2, c.v c3 from g a join g b on a.v <= b.v join g c on b.v <= c.v),
iv as (select (select count(*) from g where g.v < score) b, y, count(*) n from ob group by all),
d as (select c1, c2, c3, y, n, 1 + (gv >= c1)::int + (gv >= c2)::int + (gv >= c3)::int cls
      from cd, (select iv.*, (select max(v) from (select v, row_number() over (order by v) r from g) where r = iv.b) gv from iv)),
k as (select c1, c2, c3, sum(n) t, sum(n * (y - cls) * (y - cls)) o, sum(n * y) sa, sum(n * cls) sb,
             sum(n * (y * y + cls * cls)) sq from d group by all),
r as (select c1, c2, c3, 1 - o / nullif(sq - 2e0 * sa * sb / t, 0) kappa from k)
select c1, c2, c3, round(kappa, 6) kappa from r order by kappa desc, c1, c2, c3 limit 1"""


@query("cutpoint_exact_triples", SQL_CUTPOINT_TRIPLES)
def q_cutpoint_exact_triples(spark, sf):
    """The best three cuts of a grid by Dinkelbach's iteration, against
    the score of every triple; the label follows the score with noise."""
    o = T(spark, sf, "orders")
    y = F.lit(1) + F.least(F.greatest(F.floor(F.col("o_totalprice") / 1.25e5 + ((F.col("o_custkey") % 5) - 2) / F.lit(2.5)), F.lit(0)), F.lit(3))
    d = o.select((F.col("o_totalprice") / 6.25e4).alias("score"), y.cast("int").alias("y"))
    b = cp.exact_cutpoints(d, "score", "y", n_classes=4, grid=TRIPLE_GRID)
    pick = [F.max(F.when(F.col("k") == j, F.col("cut"))).alias(f"c{j}") for j in (1, 2, 3)]
    return b.agg(*pick, F.max("kappa").alias("kappa")).select("c1", "c2", "c3", round6("kappa").alias("kappa"))


@query("cutpoint_exact")
def q_cutpoint_exact(spark, sf):
    """The best seven cuts of the order score over all real cut vectors."""
    o = orders_scored(spark, sf).select("score", "y")
    return cp.exact_cutpoints(o, "score", "y")


@query("cutpoint_search")
def q_cutpoint_search(spark, sf):
    """Coordinate search of 7 cut points from the fixed start vector."""
    o = orders_scored(spark, sf).select("score", "y")
    cuts, kappa = cp.fit_cutpoints(o, "score", "y", CUTS, step=0.5, min_step=0.0625)
    return spark.createDataFrame([(i + 1, float(v), float(kappa)) for i, v in enumerate(cuts)],
                                 "k int, cut double, kappa double")


def ens_preds(spark, sf, runs: int = 3):
    """Long ``(model, run, id, prediction, target)`` on the test part of each run."""
    f = holdout(T(spark, sf, "orders"), "o_orderkey", runs=runs, test_fraction=0.2)
    f = _with_models(f.filter(F.col("role") == "test"))
    return f.select(F.col("o_orderkey").alias("id"), "target", "m.model", "m.prediction", "run")


def ens_cdf(spark, sf, runs: int = 3):
    o = orders_scored(spark, sf).select("id", "y")
    f = holdout(o, "id", runs=runs, test_fraction=0.2)
    return class_cdf(f.filter(F.col("role") == "train"), "y", by=["run"])


ENS_WEIGHTS = [0.25, 0.5, 1.0]
SQL_ENS_BASE = f"""with {SQL_MODELS.strip()},
ob as ({SQL_ORDERS_BASE}),
folds as (select r.run, ob.id, ob.y,
  case when {SQL_SPLIT_KEY.format(run='r.run', id='ob.id')} < 2000 then 'test' else 'train' end role
  from ob, (select cast(unnest(generate_series(1, 3)) as integer) run) r),
h as (select run, y cls, count(*) c from folds where role = 'train' group by run, y),
cdf as (select run, cls, sum(c) over (partition by run order by cls rows unbounded preceding)
               / cast(sum(c) over (partition by run) as double) f from h),
g as (select run, cls, f, coalesce(lag(f) over (partition by run order by cls), 0e0) pf from cdf),
tp as (select f.run, f.id, f.y target, m.model, m.prediction from folds f join models m on m.id = f.id
       where f.role = 'test')"""

SQL_ENSEMBLE_ROUND = SQL_ENS_BASE + """,
cur as (select run, id, prediction blend from tp where model = 'm1'),
wt as (select unnest([2.5e-1, 5e-1, 1e0]) weight),
cand as (select tp.model, wt.weight, tp.run, tp.id, tp.target,
                (cur.blend * 1e0 + wt.weight * tp.prediction) / (1e0 + wt.weight) blend
         from tp join cur on cur.run = tp.run and cur.id = tp.id, wt),
r as (select *, row_number() over (partition by model, weight, run order by blend, id) - 1 r,
             count(*) over (partition by model, weight, run) n from cand),
dec as (select r.model, r.weight, r.run, r.target, coalesce(g.cls, 8) cls from r left join g
        on g.run = r.run and g.cls < 8
        and r.r >= (case when g.cls = 1 then 0 else floor(r.n * g.pf) end)
        and r.r < floor(greatest(r.n * g.f - 1, 0e0))),
k as (select model, weight, run, 1 - sum((target - cls) * (target - cls))
        / nullif(count(*) * (var_pop(target) + var_pop(cls) + (avg(target) - avg(cls)) ^ 2), 0) kappa
      from dec group by model, weight, run)
select model, round(weight, 6) weight, round(avg(kappa), 6) kappa_mean from k group by model, weight"""


@query("ensemble_round", SQL_ENSEMBLE_ROUND)
def q_ensemble_round(spark, sf):
    """One greedy round: every (model, weight) added to the current
    blend (model m1), CDF-decoded per run and scored by mean QWK."""
    preds = ens_preds(spark, sf)
    cur = preds.filter(F.col("model") == "m1").select("run", "id", F.col("prediction").alias("blend"))
    s = en.candidate_scores(preds, cur, 1.0, ENS_WEIGHTS, ens_cdf(spark, sf))
    return s.select("model", round6("weight").alias("weight"), round6("kappa_mean").alias("kappa_mean"))


@query("ensemble_greedy")
def q_ensemble_greedy(spark, sf):
    """Greedy selection with replacement until no candidate improves."""
    preds = materialize(ens_preds(spark, sf), "predictions")  # each round reads them, not the orders with their hashes
    chosen = en.greedy_selection(preds, ens_cdf(spark, sf).transform(fitted), weights=ENS_WEIGHTS)
    return spark.createDataFrame(chosen, "round int, model string, weight double, kappa_mean double")


# members and first models of two bags
BAGS = {0: (["m1", "m2", "m3"], ["m1"]), 1: (["m2", "m4"], ["m4", "m2"])}
BAG_WEIGHTS = [-0.25, 0.25, 0.5, 1.0]
SQL_BAGGED_ROUND = SQL_ENS_BASE + f""",
mem as (select * from (values {", ".join(f"({b}, '{m}')" for b, (ms, _) in BAGS.items() for m in ms)}) t(bag, model)),
st as (select * from (values {", ".join(f"({b}, '{m}')" for b, (_, ms) in BAGS.items() for m in ms)}) t(bag, model)),
cur as (select st.bag, run, id, avg(prediction) blend from tp join st using (model) group by all),
wt as (select unnest([{", ".join(f"{w!r}e0" for w in BAG_WEIGHTS)}]) weight),
cand as (select cur.bag, tp.model, wt.weight, tp.run, tp.id, tp.target, (cur.blend + wt.weight * tp.prediction) / (1e0 + wt.weight) blend
         from tp join mem on mem.model = tp.model join cur on cur.bag = mem.bag and cur.run = tp.run and cur.id = tp.id, wt),
r as (select *, row_number() over (partition by bag, model, weight, run order by blend, id) - 1 r,
             count(*) over (partition by bag, model, weight, run) n from cand),
dec as (select r.bag, r.model, r.weight, r.run, r.target, coalesce(g.cls, 8) cls from r left join g
        on g.run = r.run and g.cls < 8 and r.r >= (case when g.cls = 1 then 0 else floor(r.n * g.pf) end)
        and r.r < floor(greatest(r.n * g.f - 1, 0e0))),
k as (select bag, model, weight, run, 1 - sum((target - cls) * (target - cls))
        / nullif(count(*) * (var_pop(target) + var_pop(cls) + (avg(target) - avg(cls)) ^ 2), 0) kappa from dec group by all)
select cast(bag as integer) bag, model, round(weight, 6) weight, round(avg(kappa), 6) kappa_mean from k group by all"""


@query("bagged_round", SQL_BAGGED_ROUND)
def q_bagged_round(spark, sf):
    """One round of two bags in one job, weights as shares of the blend's weight."""
    preds = ens_preds(spark, sf)
    members = spark.createDataFrame([(b, m) for b, (ms, _) in BAGS.items() for m in ms], "bag int, model string")
    blend = bg.start_blends(preds, [st for _, st in BAGS.values()])
    s = bg.bag_candidate_scores(preds, members, blend, BAG_WEIGHTS, ens_cdf(spark, sf))
    return s.select("bag", "model", round6("weight").alias("weight"), round6("kappa_mean").alias("kappa_mean"))


@query("library_ensemble")
def q_library_ensemble(spark, sf):
    """Trial log -> best trials per family -> bagged selection -> all orders, by CDF and by cut-offs."""
    name = F.concat(F.lit("f"), F.substring("model", 2, 1).cast("int") % 2, F.lit("@"), F.substring("model", 2, 1))
    preds = materialize(ens_preds(spark, sf).withColumn("model", name), "predictions")
    trials = preds.groupBy("model").agg(F.corr("prediction", "target").alias("kappa_mean")).select(
        F.split("model", "@")[0].alias("family"), F.split("model", "@")[1].cast("int").alias("trial"), "kappa_mean")
    cdf = fitted(ens_cdf(spark, sf))
    out, _ = bg.library_ensemble(trials, preds, model_preds(spark, sf).withColumn("model", name), cdf, mean_cdf_pdf(cdf, over="run"),
                                 per_family=2, bags=2, init_top_k=1, weights=ENS_WEIGHTS)
    return out.select("id", round6("blend").alias("blend"), "cls_cdf", "cls_cut")


# fixed ensemble applied by ``ensemble_apply``
CHOSEN = {"m2": 1.0, "m4": 0.5, "m1": 0.25}


@query("ensemble_apply", f"""with {SQL_MODELS.strip()},
ob as ({SQL_ORDERS_BASE}),
folds as (select r.run, ob.id, ob.y,
  case when {SQL_SPLIT_KEY.format(run='r.run', id='ob.id')} < 2000 then 'test' else 'train' end role
  from ob, (select cast(unnest(generate_series(1, 3)) as integer) run) r),
h as (select run, y cls, count(*) c from folds where role = 'train' group by run, y),
c as (select run, cls, sum(c) over (partition by run order by cls rows unbounded preceding)
             / cast(sum(c) over (partition by run) as double) cdf from h),
mc as (select cls y, avg(cdf) f from c group by cls),
g as (select y, f, coalesce(lag(f) over (order by y), 0e0) pf from mc),
w as (select * from (values ('m2', 1e0), ('m4', 5e-1), ('m1', 2.5e-1)) t(model, weight)),
b as (select id, sum(weight * prediction) / sum(weight) s from models join w using (model) group by id),
r as (select id, s, row_number() over (order by s, id) - 1 r, count(*) over () n from b)
select r.id, round(r.s, 6) blend, cast(coalesce(g.y, 8) as integer) cls_cdf,
  cast(1 + """ + " + ".join(f"case when r.s > {c}e0 then 1 else 0 end" for c in CUTS) + """ as integer) cls_cut
from r left join g on g.y < 8
 and r.r >= (case when g.y = 1 then 0 else floor(r.n * g.pf) end)
 and r.r < floor(greatest(r.n * g.f - 1, 0e0))""")
def q_ensemble_apply(spark, sf):
    """Apply a chosen weighted ensemble to all rows; decode by the
    fold-averaged CDF and by fixed cutoffs."""
    w = spark.createDataFrame(list(CHOSEN.items()), "model string, weight double")
    b = en.blend_weighted(model_preds(spark, sf), w, out="blend")
    mc = mean_cdf_pdf(ens_cdf(spark, sf), over="run")
    d = dc.decode_cdf(b, "blend", "id", mc, out="cls_cdf")
    return d.select("id", round6("blend").alias("blend"), "cls_cdf",
                    dc.decode_cut("blend", CUTS).alias("cls_cut"))


@query("top_trials", """
with t as (select p_type model, p_partkey trial, sin(p_retailprice) * 5e-1 + p_size / 1e2 kappa_mean from part)
select model, trial, round(kappa_mean, 6) kappa_mean,
       row_number() over (partition by model order by kappa_mean desc, trial) rank
from t qualify rank <= 10""")
def q_top_trials(spark, sf):
    """The ten best trials per model (skew-safe two-stage top-k)."""
    p = T(spark, sf, "part").select(F.col("p_type").alias("model"), F.col("p_partkey").alias("trial"),
                                    (F.sin("p_retailprice") * 0.5 + F.col("p_size") / 1e2).alias("kappa_mean"))
    t = en.top_k_per_group(p, ["model"], "kappa_mean", 10, "trial")
    return t.select("model", "trial", round6("kappa_mean").alias("kappa_mean"), F.col("rank").cast("bigint"))


@query("cutpoint_random_search")
def q_cutpoint_random_search(spark, sf):
    """Seeded random population search of 7 cut points in [0, 9]."""
    o = orders_scored(spark, sf).select("score", "y")
    cuts, kappa = cp.random_search_cutpoints(o, "score", "y", n_candidates=64, generations=4, seed=0)
    return spark.createDataFrame([(i + 1, float(v), float(kappa)) for i, v in enumerate(cuts)],
                                 "k int, cut double, kappa double")


@query("cut_refit_kappa")
def q_cut_refit_kappa(spark, sf):
    """Kappa of the order score after an internal cut-point refit (the
    evaluation hook), next to the kappa of the fixed start cuts (M15)."""
    from ordlab.operators.metrics import qwk
    from ordlab.operators.ml import CutRefitKappaEvaluator
    o = orders_scored(spark, sf).select("score", "y")
    refit = CutRefitKappaEvaluator(predictionCol="score", labelCol="y", start=CUTS, min_step=0.125).evaluate(o)
    start = qwk(o.withColumn("cls", dc.decode_cut("score", CUTS)), "y", "cls").first()[0]
    return spark.createDataFrame([(float(start), float(refit))], "kappa_start double, kappa_refit double")
