"""Stand-ins for the reference's wide table, derived from the driver tables
(SURVEY §7.3): ids, an ordinal label 1..8, a real score, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlab.plans.catalog import T

# SQL fragments shared by the oracle texts
SQL_ORDERS_BASE = """
select o_orderkey id, cast((o_custkey % 8) + 1 as integer) y,
       o_totalprice / 6.25e4 score, o_orderstatus, o_orderpriority, o_totalprice
from orders"""

SQL_SPLIT_KEY = ("(cast('0x' || substr(md5(cast({run} as varchar) || ':' || cast({id} as varchar)), 1, 8) as bigint)"
                 " % 10000)")
SQL_KEY = "(cast('0x' || substr(md5(cast({id} as varchar)), 1, 8) as bigint) % 10000)"


def orders_scored(spark: SparkSession, sf: str) -> DataFrame:
    """``id, y, score`` plus the order categories."""
    o = T(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    ((F.col("o_custkey") % 8) + 1).cast("int").alias("y"),
                    (F.col("o_totalprice") / F.lit(6.25e4)).alias("score"),
                    "o_orderstatus", "o_orderpriority", "o_totalprice")


def part_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``id, y`` and eight class scores ``s`` built from part columns:
    ``s_k = sin(p_retailprice/100 + k) + (p_size % 8 + 1 - k) / 8``."""
    p = T(spark, sf, "part")
    s = F.array(*[F.sin(F.col("p_retailprice") / F.lit(100.0) + F.lit(float(k)))
                  + ((F.col("p_size") % 8 + 1) - F.lit(k)).cast("double") / F.lit(8.0) for k in range(1, 9)])
    return p.select(F.col("p_partkey").alias("id"), ((F.col("p_size") % 8) + 1).cast("int").alias("y"),
                    s.alias("s"), "p_retailprice", "p_size", "p_brand", "p_type")


SQL_PART_SCORES = """
select p_partkey id, cast((p_size % 8) + 1 as integer) y, p_retailprice, p_size, p_brand, p_type,
  [sin(p_retailprice / 100e0 + 1e0) + cast((p_size % 8 + 1) - 1 as double) / 8e0,
   sin(p_retailprice / 100e0 + 2e0) + cast((p_size % 8 + 1) - 2 as double) / 8e0,
   sin(p_retailprice / 100e0 + 3e0) + cast((p_size % 8 + 1) - 3 as double) / 8e0,
   sin(p_retailprice / 100e0 + 4e0) + cast((p_size % 8 + 1) - 4 as double) / 8e0,
   sin(p_retailprice / 100e0 + 5e0) + cast((p_size % 8 + 1) - 5 as double) / 8e0,
   sin(p_retailprice / 100e0 + 6e0) + cast((p_size % 8 + 1) - 6 as double) / 8e0,
   sin(p_retailprice / 100e0 + 7e0) + cast((p_size % 8 + 1) - 7 as double) / 8e0,
   sin(p_retailprice / 100e0 + 8e0) + cast((p_size % 8 + 1) - 8 as double) / 8e0] s
from part"""


def docs_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """documents LEFT JOIN labels: the natural nulls."""
    d = T(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = T(spark, sf, "labels")
    return d.join(lab, "doc_id", "left")


def split_col(id_col: str, test_fraction: float = 0.2, run=None):
    """``'test'``/``'train'`` from the repeatable hash key."""
    from ordlab.operators.split import split_key, BUCKETS
    return F.when(split_key(id_col, run) < int(round(test_fraction * BUCKETS)), F.lit("test")).otherwise(F.lit("train"))


def sql_split(id_col: str, test_fraction: float = 0.2) -> str:
    cut = int(round(test_fraction * 10000))
    return f"case when {SQL_KEY.format(id=id_col)} < {cut} then 'test' else 'train' end"


SQL_DOCS_LABELLED = """
select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
from documents d left join labels l on l.doc_id = d.doc_id"""
