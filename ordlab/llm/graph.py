"""Connected components of a link table by alternating star contraction.

Each round replaces links by links to the least neighbour (large star: of the
larger neighbours; small star: of the smaller ones and the node itself), which
needs a number of rounds that is logarithmic in the size of a component.  All
steps are aggregates and joins; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.llm.common import materialize


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star operation over links (u > v)."""
    if large:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = e
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    j = near.join(least, "u")
    if large:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one link to a lesser node, or only greater ones."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    n = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return n.filter("below > 1 OR (below > 0 AND above > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that has a link; ``comp`` is the least node
    reachable.  ``links`` has bigint columns ``u`` and ``v``; loops and repeats
    do no harm."""
    e = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(e):
        e = materialize(_star(_star(e, True), False), "links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
