"""Frame helpers: projection, row selection, joins and unions (P*, J*, U*, T*).

Scalars that come from a one-row aggregate (a mean, a total, fitted
coefficients) are attached with a scalar subquery, evaluated once and
inlined, instead of a join on a constant key (which the planner would turn
into a nested-loop cross join).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame, columns=None) -> DataFrame:
    """Add the columns of a one-row DataFrame (an ungrouped aggregate) to every
    row through one scalar subquery holding them as a struct."""
    cols = list(columns or one_row.columns)
    s = one_row.select(F.struct(*cols).alias("__s")).scalar()
    return df.withColumns({c: s.getField(c) for c in cols})


def scalar(one_row: DataFrame, column: str) -> Column:
    """One value of a one-row DataFrame as a scalar-subquery column."""
    return one_row.select(column).scalar()


def project(df: DataFrame, cols) -> DataFrame:
    """P1."""
    return df.select(*cols)


def drop(df: DataFrame, cols) -> DataFrame:
    """P2."""
    return df.drop(*cols)


def columns_except(df: DataFrame, excluded) -> list[str]:
    """Column-set difference in the frame's own column order."""
    ex = set(excluded)
    return [c for c in df.columns if c not in ex]


def columns_like(df: DataFrame, fragment: str | None = None, regex: str | None = None) -> list[str]:
    """Column names containing a fragment or matching a regex."""
    if regex is not None:
        return [c for c in df.columns if re.search(regex, c)]
    return [c for c in df.columns if fragment in c]


def insert_column(df: DataFrame, name: str, col: Column, position: int) -> DataFrame:
    """P5: add a column at a position."""
    cols = [c for c in df.columns if c != name]
    cols.insert(position, name)
    return df.withColumn(name, col).select(*cols)


def constant(df: DataFrame, name: str, value) -> DataFrame:
    """P6."""
    return df.withColumn(name, F.lit(value))


def overwrite_where(df: DataFrame, name: str, cond: Column, value) -> DataFrame:
    """``col[mask] = v``."""
    return df.withColumn(name, F.when(cond, F.lit(value)).otherwise(F.col(name)))


def rows_with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an id table (semi join; AQE broadcasts the id
    table only when its measured size allows)."""
    return df.join(ids.select(key), key, "left_semi")


def rows_without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def copy_columns(df: DataFrame, other: DataFrame, key: str, cols) -> DataFrame:
    """Bring columns of another frame over by key (left join)."""
    return df.join(other.select(key, *cols), key, "left")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """``df[c].map(series)`` — a keyed lookup (left join on the key)."""
    t = table.select(key, F.col(value).alias(out or value))
    return df.join(t, key, "left")


def union_tagged(a: DataFrame, b: DataFrame, tag: str = "split", names=("train", "test")) -> DataFrame:
    """Row union by column name, missing columns null, with a tag."""
    return (a.withColumn(tag, F.lit(names[0]))
             .unionByName(b.withColumn(tag, F.lit(names[1])), allowMissingColumns=True))


def match(df: DataFrame, table: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join ``table`` on equal ``keys`` where a null key equals a null key."""
    keys = list(keys)
    t = table.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(f"__k_{k}").eqNullSafe(F.col(f"__d_{k}")) for k in keys]
    d = df.withColumns({f"__d_{k}": F.col(k) for k in keys})
    return d.join(t, on, how).drop(*[f"__k_{k}" for k in keys], *[f"__d_{k}" for k in keys])


def split_back(df: DataFrame, tag: str = "split", names=("train", "test")) -> tuple[DataFrame, DataFrame]:
    """U3."""
    return df.filter(F.col(tag) == names[0]), df.filter(F.col(tag) == names[1])


def sample_models(models: DataFrame, key: str, fraction: float, seed: int, replace: bool = False,
                  draws: int = 1) -> DataFrame:
    """T5: a seeded subset of a model table (integer key).  Without
    replacement a row is kept when its split-hash bucket for ``seed`` falls
    below ``fraction``; with replacement each of ``draws`` draws is an
    independent hashed Bernoulli(fraction) and a row may appear several times
    (column ``draw``)."""
    from ordlab.operators.split import BUCKETS, split_key
    cut = int(round(fraction * BUCKETS))
    if not replace:
        return models.filter(split_key(key, F.lit(seed)) < cut)
    ex = models.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return ex.filter(split_key(key, F.lit(seed * 1000) + F.col("draw")) < cut)
