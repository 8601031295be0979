"""FTRL queries (L15-L19, ST1)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ordlab.functions.scalar import round6
from ordlab.operators import ftrl
from ordlab.plans.catalog import T, query

# fixed learner settings of the FTRL queries
PRM = dict(alpha=0.1, beta=1.0, l1=1.0, l2=1.0)


def part_long(spark, sf):
    """One-hot long rows of part: brand, type and size decade."""
    p = T(spark, sf, "part")
    feats = F.array(F.concat(F.lit("p_brand="), "p_brand"), F.concat(F.lit("p_type="), "p_type"),
                    F.concat(F.lit("size="), F.floor(F.col("p_size") / 10).cast("string")))
    return p.select(F.col("p_partkey").alias("id"), F.explode(feats).alias("feature"), F.lit(1.0).alias("value"))


SQL_PART_LONG = """
l as (select p_partkey id, 'p_brand=' || p_brand feature, 1e0 value from part union all
      select p_partkey, 'p_type=' || p_type, 1e0 from part union all
      select p_partkey, 'size=' || cast(p_size // 10 as varchar), 1e0 from part)"""

SQL_STEP_TAIL = """
select feature, round(g, 6) z, round(g * g, 6) n,
  round(case when abs(g) <= 1e0 then 0e0 else (sign(g) * 1e0 - g) / ((1e0 + sqrt(g * g)) / 1e-1 + 1e0) end, 6) w
from g"""


def _one_step(spark, sf, label, link):
    long = part_long(spark, sf)
    labels = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), label.alias("y"))
    prm = ftrl.FtrlParams(link=link, **PRM)
    st = ftrl.step(long, labels, ftrl.zero_state(long), prm)
    return st.select("feature", *[round6(x).alias(x) for x in ["z", "n", "w"]])


@query("ftrl_one_step_reg", f"""with {SQL_PART_LONG.strip()},
y as (select p_partkey id, p_retailprice / 1e3 y from part),
g as (select l.feature, sum((0e0 - y.y) * l.value) g from l join y on y.id = l.id group by l.feature)
""" + SQL_STEP_TAIL)
def q_ftrl_one_step_reg(spark, sf):
    """One FTRL-proximal regression step from the zero state."""
    return _one_step(spark, sf, F.col("p_retailprice") / 1e3, "identity")


@query("ftrl_one_step_bin", f"""with {SQL_PART_LONG.strip()},
y as (select p_partkey id, case when p_size > 25 then 1e0 else 0e0 end y from part),
g as (select l.feature, sum((5e-1 - y.y) * l.value) g from l join y on y.id = l.id group by l.feature)
""" + SQL_STEP_TAIL)
def q_ftrl_one_step_bin(spark, sf):
    """One logistic FTRL step from the zero state (p = 0.5)."""
    return _one_step(spark, sf, F.when(F.col("p_size") > 25, 1.0).otherwise(0.0), "logistic")


def emb_long(df):
    return df.select(F.col("vec_id").alias("id"),
                     F.posexplode("embedding").alias("pos", "value")) \
        .select("id", F.concat(F.lit("d"), F.col("pos").cast("string")).alias("feature"),
                F.col("value").cast("double").alias("value"))


def emb_labels(df):
    return df.select(F.col("vec_id").alias("id"), F.when(F.col("label") >= 5, 1.0).otherwise(0.0).alias("y"))


@query("ftrl_fit")
def q_ftrl_fit(spark, sf):
    """Two epochs of mini-batches of 100 embeddings (binary label
    ``label >= 5``), with the epoch's validation log-loss kept (best epoch)."""
    import uuid
    from ordlab.session import checkpoint_dir
    from ordlab.sources import files
    e = T(spark, sf, "embeddings")
    path = os.path.join(checkpoint_dir(spark), f"ordlab-sparse-{uuid.uuid4().hex}")
    files.write_sparse(emb_long(e), path)  # S14: sparse matrix as (row, col, value)
    long = spark.read.parquet(path)
    prm = ftrl.FtrlParams(link="logistic", alpha=0.5, beta=1.0, l1=0.1, l2=0.1)
    st, hist = ftrl.fit(long, emb_labels(e), prm, batch_size=100, epochs=2,
                        valid_long=long, valid_labels=emb_labels(e), metric="logloss")
    return st.select("feature", round6("z").alias("z"), round6("n").alias("n"), round6("w").alias("w"))


@query("ftrl_stream")
def q_ftrl_stream(spark, sf):
    """ST1: the same learner driven by Structured Streaming over the
    embeddings file; state carried from micro-batch to micro-batch."""
    from ordlab.session import checkpoint_dir
    from ordlab.streaming.ftrl_stream import run_stream
    import uuid
    e = T(spark, sf, "embeddings")
    # a file source watches a folder or a glob; the glob names the one table file
    src = (spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1)
           .parquet(os.path.join(sf, "embeddings.parque[t]")))
    src = src.select("vec_id", "embedding", "label").withColumn("id", F.col("vec_id")) \
        .withColumn("y", F.when(F.col("label") >= 5, 1.0).otherwise(0.0))
    prm = ftrl.FtrlParams(link="logistic", alpha=0.5, beta=1.0, l1=0.1, l2=0.1)
    root = os.path.join(checkpoint_dir(spark), f"ordlab-stream-{uuid.uuid4().hex}")
    st = run_stream(spark, src, emb_long, prm, batch_size=100, root=root)
    return st.select("feature", round6("w").alias("w"))


SQL_FTRL_MULTICLASS = f"""with {SQL_PART_LONG.strip()},
c as (select cast(unnest(generate_series(1, 4)) as integer) cls),
y as (select p_partkey id, p_size % 4 + 1 y, 1e0 + p_partkey % 3 w from part),
s0 as (select l.feature, c.cls, sum(y.w * (5e-1 - (y.y = c.cls)::int) * l.value) g from l join y on y.id = l.id, c group by all),
s1 as (select feature, cls, g z, g * g n,
         case when abs(g) <= 1e0 then 0e0 else (sign(g) - g) / ((1e0 + abs(g)) / 1e-1 + 1e0) end w from s0),
m as (select l.id, s1.cls, sum(s1.w * l.value) m from l join s1 on s1.feature = l.feature group by all),
d as (select m.id, m.cls, y.w * (1e0 / (1e0 + exp(-greatest(-35e0, least(35e0, m.m)))) - (y.y = m.cls)::int) d from m join y on y.id = m.id),
g as (select l.feature, d.cls, sum(d.d * l.value) g from l join d on d.id = l.id group by all),
u as (select feature, cls, z + g - (sqrt(n + g * g) - sqrt(n)) / 1e-1 * w z, n + g * g n from s1 join g using (feature, cls))
select feature, cls, round(z, 6) z, round(n, 6) n,
  round(case when abs(z) <= 1e0 then 0e0 else (sign(z) - z) / ((1e0 + sqrt(n)) / 1e-1 + 1e0) end, 6) w from u"""


@query("ftrl_multiclass", SQL_FTRL_MULTICLASS)
def q_ftrl_multiclass(spark, sf):
    """Two weighted steps of four classes over all parts, state keyed (feature, class)."""
    from ordlab.operators import ftrl_multi as fm
    long = part_long(spark, sf)
    labels = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 + 1).alias("y"),
                                         (F.lit(1.0) + F.col("p_partkey") % 3).alias("weight"))
    classes, prm = [1, 2, 3, 4], ftrl.FtrlParams(**PRM)
    st = fm.zero_state(long, classes)
    for _ in range(2):
        st = fm.step(long, labels, st, prm, classes, "weight")
    rows = st.select("feature", F.posexplode(F.arrays_zip("z", "n", "w")).alias("j", "x"))
    return rows.select("feature", (F.col("j") + 1).alias("cls"), *[round6(f"x.{x}").alias(x) for x in "znw"])
