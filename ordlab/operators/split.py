"""Repeatable holdouts and folds (H1-H6).

The split key of a row is 32 bits of the MD5 of ``run:id`` (of ``id`` alone
without a run), modulo 10000, so runs, bags and nested layers are independent of
each other and a row's role depends only on its id and the run: no sort, no
shuffle, no id list on the driver, and the same split after an executor loss.
Ids may be numbers or strings; the same text gives the same key in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import c

BUCKETS = 10000


def split_key(id_col, run=None) -> Column:
    """0..9999 bucket of ``(run, id)``; a null id has a bucket of its own."""
    text = F.coalesce(c(id_col).cast("string"), F.lit(""))
    if run is not None:
        text = F.concat(c(run).cast("string"), F.lit(":"), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(BUCKETS)


def holdout(df: DataFrame, id_col: str, runs: int = 6, test_fraction: float = 0.2,
            run_col: str = "run", role_col: str = "role",
            roles: tuple[str, str] = ("train", "test"), first_run: int = 1) -> DataFrame:
    """H1/H2/H3: ``runs`` seeded holdouts; every row appears once per run with
    role ``roles[1]`` for a ``test_fraction`` share, ``roles[0]`` otherwise."""
    cut = int(round(test_fraction * BUCKETS))
    out = df.withColumn(run_col, F.explode(F.sequence(F.lit(first_run), F.lit(first_run + runs - 1))))
    return out.withColumn(role_col, F.when(split_key(id_col, F.col(run_col)) < cut, F.lit(roles[1]))
                          .otherwise(F.lit(roles[0])))


def fold_table(df: DataFrame, id_col: str, runs: int = 6, test_fraction: float = 0.2) -> DataFrame:
    """H1 stored form: ``(run, id, role)``."""
    return holdout(df.select(id_col), id_col, runs, test_fraction)


def kfold(df: DataFrame, id_col: str, k: int, fold_col: str = "fold", run=None) -> DataFrame:
    """``k`` disjoint folds from the same hash (usable as ``CrossValidator`` ``foldCol``)."""
    return df.withColumn(fold_col, (split_key(id_col, run) % F.lit(k)).cast("int"))


def fold_metadata(folds: DataFrame, label: str, n_classes: int = 8, by=("run",),
                  role_col: str = "role", train_role: str = "train") -> tuple[DataFrame, DataFrame]:
    """H4: group sizes per (run, role) and the class CDF of each run's train part (Q12)."""
    from ordlab.operators.profile import class_cdf
    sizes = folds.groupBy(*by, role_col).agg(F.count(F.lit(1)).alias("n"))
    cdf = class_cdf(folds.filter(F.col(role_col) == train_role), label, by=list(by), n_classes=n_classes)
    return sizes, cdf


def bags(df: DataFrame, id_col: str, n_bags: int, test_fraction: float,
         bag_col: str = "bag") -> DataFrame:
    """H6: ``n_bags`` seeded resplits as a long ``(bag, id, role)`` table."""
    return holdout(df, id_col, runs=n_bags, test_fraction=test_fraction, run_col=bag_col)
