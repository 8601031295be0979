"""Feature selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import select as sel
from ordlab.plans.catalog import T, query

# feature stand-ins built from part columns
PART_FEATURES = {
    "f_size": "cast(p_size as double)",
    "f_price": "p_retailprice",
    "f_key97": "cast(p_partkey % 97 as double)",
    "f_namelen": "cast(length(p_name) as double)",
    "f_sinp": "sin(p_retailprice)",
    "f_prod": "p_size * p_retailprice / 1e3",
    "f_cosk": "cos(p_partkey)",
    "f_key13": "cast(p_partkey % 13 as double)",
}
PCTS = list(range(15, 100, 5))


def part_features(spark, sf):
    p = T(spark, sf, "part")
    return p.select("p_partkey", ((F.col("p_size") % 8) + 1).cast("int").alias("y"),
                    *[F.expr(v).alias(k) for k, v in PART_FEATURES.items()])


SQL_F_SCORE = ("with p as (select p_partkey, cast((p_size % 8) + 1 as double) y, "
               + ", ".join(f"{v} {k}" for k, v in PART_FEATURES.items()) + " from part),\n"
               + "r as (" + "\nunion all\n".join(
                   f"select '{k}' feature, count(*) n, corr({k}, y) r from p" for k in PART_FEATURES) + "),\n"
               + """s as (select feature, r, r * r / nullif(1e0 - r * r, 0e0) * (n - 2) f from r),
k as (select feature, r, f, row_number() over (order by f desc nulls last, feature) rank, count(*) over () kk from s),
pc as (select unnest(generate_series(15, 95, 5)) pct)
select cast(pc.pct as integer) pct, k.feature, round(k.f, 6) f_score, k.rank from k, pc
where k.rank <= floor(pc.pct * k.kk / 100)""")


@query("f_score_percentile", SQL_F_SCORE)
def q_f_score_percentile(spark, sf):
    """F-test score per feature, features kept for percentiles 15..95."""
    p = part_features(spark, sf)
    s = sel.f_scores(p, list(PART_FEATURES), "y")
    k = sel.percentile_keep(s, PCTS)
    return k.select(F.col("pct").cast("int"), "feature", round6("f_score").alias("f_score"),
                    F.col("rank").cast("bigint"))


def emb_features(spark, sf):
    """Embeddings with a column per dimension, as many as the table has."""
    e = T(spark, sf, "embeddings")
    dims = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i + 1}") for i in range(dims)])


SQL_PAIR_MIC = """
with e as (select vec_id id, embedding from embeddings),
l as (select id, g.f fi, cast(embedding[g.f] as double) v from e, (select unnest(generate_series(1, (select max(len(embedding)) from embeddings))) f) g),
n as (select count(*) n, cast(floor(6e-1 * log2(count(*))) as integer) total from e),
bins as (select id, fi, cast(floor((row_number() over (partition by fi order by v, id) - 1) * pow(2, n.total - 1) / n.n) as integer) b from l, n),
joint as (select x.fi fa, y.fi fb, x.b ix, y.b iy, count(*) c from bins x join bins y on y.id = x.id and x.fi < y.fi
          group by x.fi, y.fi, x.b, y.b),
s as (select cast(unnest(generate_series(1, 60)) as integer) k),
grids as (select x.k gx, y.k gy from s x, s y, n where x.k + y.k <= n.total),
cells as (select fa, fb, gx, gy, ix >> (n.total - 1 - gx) ix, iy >> (n.total - 1 - gy) iy, sum(c) c from joint, grids, n
          group by fa, fb, gx, gy, ix >> (n.total - 1 - gx), iy >> (n.total - 1 - gy)),
m as (select *, sum(c) over (partition by fa, fb, gx, gy, ix) cx, sum(c) over (partition by fa, fb, gx, gy, iy) cy from cells),
mi as (select fa, fb, gx, gy, sum(c / n.n * ln(c * n.n / (cx * cy))) mi from m, n group by fa, fb, gx, gy)
select 'e' || cast(fa as varchar) feature_a, 'e' || cast(fb as varchar) feature_b,
       round(max(mi / (least(gx, gy) * ln(2))), 6) mic, max(mi / (least(gx, gy) * ln(2))) > 1e-1 selected
from mi group by fa, fb"""


@query("pair_mi_grid", SQL_PAIR_MIC)
def q_pair_mi_grid(spark, sf):
    """Approximate MIC for every pair of embedding dimensions, and the
    pairs above 0.10."""
    e = emb_features(spark, sf)
    m = sel.pair_mic(e, "vec_id", [x for x in e.columns if x not in ("vec_id", "label")])
    return m.select("feature_a", "feature_b", round6("mic").alias("mic"), (F.col("mic") > 0.1).alias("selected"))


@query("pair_mic_search")
def q_pair_mic_search(spark, sf):
    """MIC with a partition search for every pair of embedding dimensions, beside the dyadic value."""
    e = emb_features(spark, sf)
    names = [x for x in e.columns if x not in ("vec_id", "label")]
    bins = sel.Bins(e, "vec_id", names)  # sorted once for both
    fine = sel.pair_mic_search(e, "vec_id", names, bins=bins)
    coarse = sel.pair_mic(e, "vec_id", names, bins=bins).withColumnRenamed("mic", "mic_dyadic")
    return fine.join(coarse, ["feature_a", "feature_b"]).select("feature_a", "feature_b", round6("mic").alias("mic"),
                                                               round6("mic_dyadic").alias("mic_dyadic"))


@query("mrmr_select")
def q_mrmr_select(spark, sf):
    """Z3: greedy mRMR over the MIC table of all dimensions and the label."""
    e = emb_features(spark, sf)
    feats = [x for x in e.columns if x not in ("vec_id", "label")] + ["label"]
    pairs = sel.pair_mic(e, "vec_id", feats)
    picks = sel.mrmr(pairs, "label")
    return spark.createDataFrame(picks, "step int, feature string, gain double")
