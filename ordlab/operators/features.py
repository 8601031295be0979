"""Encoding and feature derivation.

Fitted values (category codes, group statistics, scaling moments) are small
aggregates joined back on their key; the join is left to AQE, which turns it
into a broadcast only after measuring the aggregate at run time and otherwise
keeps a shuffle join with skew splitting for hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordlab.functions.scalar import c, guarded_ratio, row_sum, row_sum_skip_null, safe_div, uniform
from ordlab.operators.frame import attach, match
from ordlab.session import fitted
from ordlab.operators.rank import position, window_position


#: levels that a plain window may number
FEW_LEVELS = 1 << 16


def label_encode(df: DataFrame, col: str, out: str | None = None, per_split: str | None = None) -> DataFrame:
    """code = index of the value among the sorted distinct values.

    Default fits on all rows (E2, the union of train and test); with
    ``per_split`` the codes are refitted inside each split (Q5).  Nulls keep a
    null code.  The levels are written once; many are numbered by the scalable
    ``position``, few by a window, and their size decides how they are joined."""
    out = out or f"{col}_code"
    keys = [per_split] if per_split else []
    levels = fitted(df.select(*keys, col).filter(F.col(col).isNotNull()).distinct(), "levels")
    if levels.count() <= FEW_LEVELS:  # measured: small enough for a window
        codes = window_position(levels, [col], out, partition_by=keys or None)
    else:
        codes = fitted(position(levels, [col], out, partition_by=keys or None), "codes")
    return match(df, codes.withColumn(out, F.col(out).cast("int")), keys + [col])


def one_hot_levels(df: DataFrame, cols) -> dict:
    """Distinct levels of each column in order, from one aggregate.  They become
    output columns, so they reach the driver; ``one_hot_vector`` is the form for
    columns with more levels than a table should have columns."""
    cols = list(cols)
    sets = df.agg(*[F.collect_set(c).alias(c) for c in cols]).first()
    return {c: sorted(v for v in sets[c] if v is not None) for c in cols}


def one_hot(df: DataFrame, cols, levels: dict | None = None, sep: str = ".", keep=None) -> DataFrame:
    """Indicator column ``{col}{sep}{value}`` per level; levels come from
    the frame given (train+test union, E3) or from a fitted dict (E4: fit on
    train, unseen test values -> all zeros, Q6).  Other columns pass through."""
    cols = list(cols)
    levels = levels or one_hot_levels(df, cols)
    out = []
    for x in df.columns:
        if x in cols:
            for v in levels[x]:
                out.append(F.when(F.col(x) == F.lit(v), 1).otherwise(0).alias(f"{x}{sep}{v}"))
        elif keep is None or x in keep:
            out.append(F.col(x))
    return df.select(*out)


def one_hot_vector(df: DataFrame, col: str, out: str | None = None):
    """E3 at high cardinality: ``StringIndexer`` + ``OneHotEncoder(dropLast=False)``
    into a sparse vector column."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    out = out or f"{col}_vec"
    idx = StringIndexer(inputCol=col, outputCol=f"{col}__ix", stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    enc = OneHotEncoder(inputCol=f"{col}__ix", outputCol=out, dropLast=False).fit(idx.transform(df))
    return enc.transform(idx.transform(df)).drop(f"{col}__ix")


def code_split(df: DataFrame, col: str, letter: str | None = None, number: str | None = None) -> DataFrame:
    """Letter part (first char) and number part (the rest) of a code."""
    letter = letter or f"{col}_letter"
    number = number or f"{col}_number"
    return (df.withColumn(letter, F.substring(F.col(col), 1, 1))
              .withColumn(number, F.expr(f"substring(`{col}`, 2)")))


def body_features(df: DataFrame, ht: str, wt: str, bmi: str, age: str, den: str) -> DataFrame:
    """Body-measure features; ``Wt_Age`` is computed for every row (Q8)
    and ``BMI_H32`` is the guarded ratio ``bmi / den`` (0 where den is 0)."""
    # fixed values: coefficients of the derived body features
    return df.withColumns({
        "scale": F.lit(6.1e-3) * F.col(ht) + F.lit(1.28e-2) * F.col(wt),
        "Fat": F.lit(1.2) * F.col(bmi) + F.lit(0.23) * F.col(age),
        "Ht_BMI": F.col(ht) * F.col(bmi),
        "BMI_H32": guarded_ratio(bmi, den),
        "BMI_Age": F.col(bmi) * F.col(age),
        "Wt_Age": F.col(wt) - F.col(age),
    })


def pair_features(df: DataFrame, a: str, b: str, prefix: str = "pair") -> DataFrame:
    """``_1`` product, ``_2`` sum, ``_3`` absolute difference, ``_4`` a/b and
    ``_5`` b/a (both guarded: 0 where the divisor is 0)."""
    return df.withColumns({
        f"{prefix}_1": F.col(a) * F.col(b),
        f"{prefix}_2": F.col(a) + F.col(b),
        f"{prefix}_3": F.abs(F.col(a) - F.col(b)),
        f"{prefix}_4": guarded_ratio(a, b),
        f"{prefix}_5": guarded_ratio(b, a),
    })


def all_features(df: DataFrame, cols, prefix: str = "all") -> DataFrame:
    """Sum (``_1``) and product (``_2``) over a column list."""
    from functools import reduce
    from operator import mul
    return df.withColumns({f"{prefix}_1": row_sum(cols),
                           f"{prefix}_2": reduce(mul, [F.col(x) for x in cols])})


def count_features(df: DataFrame, groups: dict) -> DataFrame:
    """``{out: [flag columns]}`` horizontal sums (null if any input is null)."""
    return df.withColumns({k: row_sum(v) for k, v in groups.items()})


def family_sums(df: DataFrame, fragments, prefix: str = "fam_") -> DataFrame:
    """Null-skipping sum of every column whose name contains a fragment."""
    out = {}
    for frag in fragments:
        cols = [x for x in df.columns if frag in x]
        out[f"{prefix}{frag}"] = row_sum_skip_null(cols) if cols else F.lit(0)
    return df.withColumns(out)


def target_encode_loo(df: DataFrame, col: str, y: str, is_train, out: str | None = None,
                      prior_weight: float = 15.0, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Smoothed leave-one-out target mean.

    ``(S - y*[train] + k*m) / (n - [train] + k)`` with S, n the train sum and
    count of the row's category, m the train mean and k the prior weight; an
    unseen category gets ``n=0, S=m`` (Q9).  Category statistics are a partial
    aggregate joined back on the category (skew-safe), the train mean a
    one-row aggregate joined on a constant key.  ``noise`` multiplies train
    rows by ``1 + noise*(u-0.5)``, u hashed from the row and the seed (off by default)."""
    out = out or f"{col}_te"
    tr = F.col("__tr")
    d = df.withColumn("__tr", F.when(c(is_train), 1).otherwise(0))
    train = d.filter(tr == 1)
    stats = fitted(train.groupBy(col).agg(F.sum(y).cast("double").alias("__s"),
                                          F.count(F.lit(1)).alias("__n")), "target-stats")
    j = attach(d.join(stats, col, "left"), train.agg(F.avg(y).alias("__m")))
    cnt = F.coalesce(F.col("__n"), F.lit(0)) - tr
    csm = F.coalesce(F.col("__s"), F.col("__m")) - F.when(tr == 1, F.col(y)).otherwise(F.lit(0.0))
    enc = (csm + F.lit(prior_weight) * F.col("__m")) / (cnt + F.lit(prior_weight))
    enc = F.coalesce(enc, F.col("__m"))
    if noise:
        enc = F.when(tr == 1, enc * (F.lit(1.0) + F.lit(noise) * (uniform(df.columns, seed) - F.lit(0.5)))).otherwise(enc)
    return j.withColumn(out, enc).drop("__tr", "__s", "__n", "__m")


def woe_encode(df: DataFrame, col: str, target: str, out: str | None = None, smoothing: float = 0.5) -> DataFrame:
    """Weight of evidence ``ln((n1/N1) / (n0/N0))`` of each category
    against a binary target; ``smoothing`` is added to every cell count so
    empty cells stay finite.  Returns the per-category table."""
    out = out or f"{col}_woe"
    y = F.when(c(target) > 0, 1).otherwise(0)
    g = df.filter(c(target).isNotNull()).groupBy(col).agg(
        F.sum(y).alias("n1"), F.sum(F.lit(1) - y).alias("n0"))
    s = F.lit(smoothing)
    g = fitted(g, "woe-counts")
    tot = g.agg(F.sum(F.col("n1") + s).alias("t1"), F.sum(F.col("n0") + s).alias("t0"))
    g = attach(g, tot)  # two scalars from the level table
    return g.select(col, "n1", "n0", F.ln(((F.col("n1") + s) / F.col("t1"))
                                          / ((F.col("n0") + s) / F.col("t0"))).alias(out))


def standardize(df: DataFrame, cols, fit_on=None, by=None, suffix: str = "") -> DataFrame:
    """``(x - mean) / std_pop`` with moments from the ``fit_on`` rows
    (a boolean column, e.g. train rows) and applied to all rows; ``by`` fits
    per group (per batch for E14).  Zero std gives null, not an error."""
    by = list(by or [])
    base = df.filter(c(fit_on)) if fit_on is not None else df
    aggs = []
    for x in cols:
        aggs += [F.avg(x).alias(f"__m_{x}"), F.stddev_pop(x).alias(f"__s_{x}")]
    if by:
        mom = fitted(base.groupBy(*by).agg(*aggs), "moments")
        j = match(df, mom, by)
    else:
        j = attach(df, base.agg(*aggs))
    j = j.withColumns({f"{x}{suffix}": safe_div(F.col(x) - F.col(f"__m_{x}"), F.col(f"__s_{x}")) for x in cols})
    return j.drop(*[f"__m_{x}" for x in cols], *[f"__s_{x}" for x in cols])


def expression_scores(df: DataFrame, exprs: dict, offset: float = 0.0, blend: dict | None = None,
                      out: str = "score") -> DataFrame:
    """Named SQL score expressions (plus ``offset``) and an optional blend
    ``sum_k w_k (p_k - p_last) + p_last`` over them, as in the reference's
    closed-form formulas; everything is one projection in whole-stage codegen."""
    named = {k: F.expr(v) + F.lit(offset) for k, v in exprs.items()}
    d = df.withColumns(named)
    if blend:
        names = list(exprs)
        last = F.col(names[-1])
        b = last
        for k, w in blend.items():
            b = b + F.lit(float(w)) * (F.col(k) - last)
        d = d.withColumn(out, b)
    return d
