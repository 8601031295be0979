"""Flagship: QWK of a formula score on repeatable holdouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators.decode import decode_cdf
from ordlab.operators.features import expression_scores, label_encode
from ordlab.operators.metrics import qwk
from ordlab.operators.profile import class_cdf
from ordlab.operators.split import holdout
from ordlab.plans.catalog import query
from ordlab.plans.standins import SQL_SPLIT_KEY, orders_scored
from ordlab.session import materialize

RUNS = 6
TEST_FRACTION = 0.2

SQL_HOLDOUT_FORMULA_KAPPA = f"""
with b as (
  select o_orderkey id, cast((o_custkey % 8) + 1 as integer) y,
         o_totalprice / 6.25e4 + 2.5e-1 * (dense_rank() over (order by o_orderpriority) - 1) score
  from orders),
f as (
  select r.run, b.id, b.y, b.score,
         case when {SQL_SPLIT_KEY.format(run='r.run', id='b.id')} < 2000 then 'test' else 'train' end role
  from b, (select cast(unnest(generate_series(1, {RUNS})) as integer) run) r),
h as (select run, y cls, count(*) c from f where role = 'train' group by run, y),
grid as (select r.run, g.cls from (select distinct run from f) r,
         (select unnest(generate_series(1, 8)) cls) g),
hz as (select grid.run, grid.cls, coalesce(h.c, 0) c from grid left join h
       on h.run = grid.run and h.cls = grid.cls),
cdf as (select run, cls, sum(c) over (partition by run order by cls rows unbounded preceding)
               / cast(sum(c) over (partition by run) as double) f from hz),
g as (select run, cls, f, coalesce(lag(f) over (partition by run order by cls), 0e0) pf from cdf),
t as (select run, id, y, row_number() over (partition by run order by score, id) - 1 r,
             count(*) over (partition by run) n from f where role = 'test'),
dec as (select t.run, t.id, t.y, coalesce(g.cls, 8) c from t left join g
        on g.run = t.run and g.cls < 8
        and t.r >= (case when g.cls = 1 then 0 else floor(t.n * g.pf) end)
        and t.r < floor(greatest(t.n * g.f - 1, 0e0)))
select run, count(*) n_test,
       round(1 - sum((y - c) * (y - c)) / (count(*) * (var_pop(y) + var_pop(c) + (avg(y) - avg(c)) ^ 2)), 6) kappa
from dec group by run
"""


def formula_holdout_kappa(spark, sf, runs: int = RUNS, test_fraction: float = TEST_FRACTION):
    d = orders_scored(spark, sf).select("id", "y", "o_totalprice", "o_orderpriority")
    d = label_encode(d, "o_orderpriority", "prio_code")
    d = expression_scores(d, {"score": "o_totalprice / 6.25e4 + 2.5e-1 * prio_code"})
    folds = holdout(d.select("id", "y", "score"), "id", runs=runs, test_fraction=test_fraction)
    cdf = class_cdf(folds.filter(F.col("role") == "train"), "y", by=["run"])
    # the stored holdout rows: the decoder and the count read them instead of hashing every id again
    test = materialize(folds.filter(F.col("role") == "test").select("run", "id", "y", "score"), "holdout")
    dec = decode_cdf(test, "score", "id", cdf, by=["run"], out="cls")
    k = qwk(dec, "y", "cls", by=["run"])
    n = test.groupBy("run").agg(F.count(F.lit(1)).alias("n_test"))
    return n.join(k, "run").select("run", "n_test", round6("kappa").alias("kappa"))


@query("holdout_formula_kappa", SQL_HOLDOUT_FORMULA_KAPPA)
def q_holdout_formula_kappa(spark, sf):
    return formula_holdout_kappa(spark, sf)
