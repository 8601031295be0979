"""Mixing sources to target weights by Poisson replication (operator 2).

Each source gets a mean repetition rate ``budget * weight / size``.  A document
is repeated ``k`` times, where ``k`` is the Poisson quantile of a uniform number
hashed from (seed, doc_id): the result does not depend on partitioning, and a
task that runs again draws the same.  Copies are exploded and dealt to
partitions by a hash of (seed, doc_id, copy), sorted by it inside each: a
global shuffle without a range sample.  Only DataFrame functions are used.

One row per source is written once to the shared folder, so its measured size
decides between a broadcast and a shuffled join; a source that holds a third of
the rows is split by the adaptive skew join.

Null source: a source of its own.  Null or empty text: size 0; a source whose
size is 0 gets rate 0.  Null doc_id: hashed as the word ``null``.  Repeated rows
draw alike.  Extra columns are kept; the operator's own carry a ``__mix_`` prefix
until the end.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.llm.common import materialize, shuffle_partitions

SEED = "mix-1"
#: weight of a source: its size to this power, where no weights are given
TEMPERATURE = 0.5


def uniform(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below double precision."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.struct(F.lit(0.0).alias("lf"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        lf = acc["lf"] + F.log(k.cast("double"))
        s = acc["sum"] + F.exp(k * F.log(rate) - rate - lf)
        return F.struct(lf.alias("lf"), s.alias("sum"), F.concat(acc["cdf"], F.array(s)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), first, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict | None = None, budget: float | None = None,
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size, rate): sizes in characters over all documents; ``budget``
    is the size of the mixture (default: that of the input)."""
    per = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.sum(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint")).alias("size"))
    if weights is None:
        w = F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE))
    else:  # sources without a weight are left out of the mixture
        w = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    per = materialize(per.withColumn("w", w), "mix-sizes")
    tot = per.agg(F.struct(F.sum("size").cast("double").alias("t"), F.sum("w").alias("ws"))).scalar()
    b = F.lit(float(budget)) if budget is not None else tot["t"]
    rate = F.when((F.col("size") > 0) & (tot["ws"] > 0), b * (F.col("w") / tot["ws"]) / F.col("size")).otherwise(0.0)
    out = per.select("source", "size", rate.alias("rate"))
    return materialize(out.withColumn("cdf", poisson_cdf(F.col("rate"))), "mix-rates")


def mix(docs: DataFrame, weights: dict | None = None, budget: float | None = None, seed: str = SEED,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        num_partitions: int | None = None, keep: bool = True) -> DataFrame:
    """The mixture: all columns of ``docs``, each row as often as drawn, in a
    random global order; with ``keep`` also ``copy``, ``rate`` and ``mix_key``
    (which then replace columns of the same names)."""
    r = rates(docs, weights, budget, source_col, text_col).select(
        F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"), F.col("cdf").alias("__mix_cdf"))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    u = uniform(F.lit(seed), ident)
    count = F.size(F.filter("__mix_cdf", lambda c: c <= F.col("__mix_u")))
    out = (docs.join(r, F.col(f"`{source_col}`").eqNullSafe(F.col("__mix_source")))
           .withColumn("__mix_u", u).withColumn("__mix_n", count).filter("__mix_n > 0")
           .withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1)))
           .withColumn("__mix_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), ident, F.col("__mix_copy"))), 1, 15), 16, 10).cast("bigint")))
    cols = [c for c in docs.columns if not keep or c not in ("copy", "rate", "mix_key")]
    more = [F.col("__mix_copy").alias("copy"), F.col("__mix_rate").alias("rate"), F.col("__mix_key").alias("mix_key")] if keep else []
    out = out.repartition(num_partitions or shuffle_partitions(docs.sparkSession), "__mix_key").sortWithinPartitions("__mix_key")
    return out.select(*[F.col(f"`{c}`") for c in cols], *more)


SQL = f"""
WITH per AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
tot AS (SELECT CAST(sum(size) AS DOUBLE) AS t, sum(pow(CAST(size AS DOUBLE), {TEMPERATURE})) AS ws FROM per),
rates AS (
  SELECT source, CASE WHEN size > 0 AND ws > 0 THEN t * (pow(CAST(size AS DOUBLE), {TEMPERATURE}) / ws) / size ELSE 0 END AS rate
  FROM per, tot),
cdf AS (
  SELECT source, rate, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k)),
drawn AS (
  SELECT d.*, c.rate, c.n FROM (
    SELECT *, CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents) d,
  LATERAL (SELECT rate, count(*) FILTER (p <= d.u) AS n FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source GROUP BY rate) c)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, round(rate, 6) AS rate,
  CAST('0x' || substr(md5('{SEED}:' || doc_id || ':' || copy), 1, 15) AS BIGINT) AS mix_key
FROM drawn, LATERAL (SELECT unnest(range(0, n)) AS copy)
"""
