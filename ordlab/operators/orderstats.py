"""Exact order statistics without a sort.

The row at a rank is found by refining radix histograms of the order-preserving
bits of (value, id): a round counts the rows of every digit within the interval
that holds a wanted rank, for all groups and ranks in one partial aggregate,
and keeps the digit that the rank falls in.  A digit is 12 bits of the codes
that occur in its interval, so common leading bits cost no round and equal
values go over to the bits of the id at once.  Intervals of at most ``SMALL``
rows are ranked directly.  No row is written, sorted by range or held in a
buffer; what a round writes is a row per group and rank.

At worst (64 + 64) / 12 rounds are needed; a continuous score takes one round
per factor of 4,096 of the group's size beyond ``SMALL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordlab.functions.scalar import c, order_value, with_order_code
from ordlab.operators.frame import attach, match
from ordlab.session import fitted

DIGITS = 1 << 12
#: bits below the digits of the first pass
FIRST = 46
#: intervals of so many rows at most are ranked by a window (bounded, one partition each)
SMALL = 8192

_INTERVAL = ["tied", "v0", "lo", "hi", "shift", "below", "size"]
_SPANS = ["lv", "hv", "li", "hi_"]


def _span_aggs() -> list[Column]:
    """Row count and ranges of the codes."""
    return [F.count(F.lit(1)).alias("n")] + [f(x).alias(k) for k, (f, x) in
                                             zip(_SPANS, ((F.min, "__v"), (F.max, "__v"), (F.min, "__i"), (F.max, "__i")))]


def _shift(lo, hi) -> Column:
    """The least shift that leaves fewer than ``DIGITS`` digits between two codes."""
    few = lambda s: F.try_subtract(F.call_function("shiftright", hi, s), F.call_function("shiftright", lo, s)) < DIGITS
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(63)), few), F.lit(0))


def _interval(below) -> list[Column]:
    """Interval of rows with the ranges ``_SPANS``; rows of one value are told apart by their ids."""
    lv, hv, li, hi = (F.col(k) for k in _SPANS)
    tied = lv == hv
    lo, hi = F.when(tied, li).otherwise(lv), F.when(tied, hi).otherwise(hv)
    return [tied.alias("tied"), F.when(tied, lv).otherwise(F.lit(0)).alias("v0"), lo.alias("lo"), hi.alias("hi"),
            _shift(lo, hi).alias("shift"), below.cast("bigint").alias("below"), F.col("n").alias("size")]


def _open(x) -> Column:
    return (x.size > SMALL) & ~(x.tied & (x.lo == x.hi))


def _small(x) -> Column:
    return (x.size <= SMALL) & ~(x.tied & (x.lo == x.hi))


def spread(rows: DataFrame, table: DataFrame, by) -> DataFrame:
    """A pinned table of one row per group beside every row: a join whose side
    has a known size, or a scalar subquery if there are no groups."""
    return match(rows, table, by, "inner") if by else attach(rows, table)


def _within(rows: DataFrame, groups: DataFrame, by, which) -> DataFrame:
    """Rows that lie in a wanted interval of the kind ``which``, as ``x``.  An interval lies
    in one first digit, so rows meet those of their digit by an equality join."""
    at = F.explode(F.array_distinct(F.transform(F.filter("want", which), lambda x: x.at))).alias("x")
    start = F.when(F.col("x.tied"), F.col("x.v0")).otherwise(F.col("x.lo"))
    intervals = groups.select(*by, at).withColumn("__first", F.shiftright(start, FIRST))
    r = match(rows.select(*by, "__v", "__i", F.shiftright("__v", FIRST).alias("__first")), intervals, [*by, "__first"], "inner")
    lo, hi = F.col("x.lo"), F.col("x.hi")
    inside = F.when(F.col("x.tied"), (F.col("__v") == F.col("x.v0")) & F.col("__i").between(lo, hi)).otherwise(F.col("__v").between(lo, hi))
    return r.filter(inside).select(*by, "__v", "__i", "x")


def _wanted(groups: DataFrame, by) -> DataFrame:
    return groups.select(*by, F.explode("want").alias("w")).select(*by, "w.rank", "w.at")


def _collected() -> Column:
    """The wanted ranks of a group (as many as ``ends`` names) and their intervals."""
    return F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "at")))


def _pinned(groups: DataFrame) -> tuple[DataFrame, bool]:
    """The groups as a table, and whether some of them have open intervals.  (An
    observed metric would save the look at the table, but a session that has
    observed one can no longer be shipped inside ``pyspark.ml`` closures.)"""
    table = fitted(groups, "ranks")
    return table, not table.filter(F.exists("want", lambda w: _open(w.at))).isEmpty()


def rank_keys(rows: DataFrame, by, ends) -> tuple[DataFrame, DataFrame]:
    """Keys of the rows at wanted ranks.

    ``rows`` has ``by``, ``__v`` and ``__i`` (bigint codes of value and id).
    ``ends`` takes the groups ``by + [n]`` and adds an array column ``__ends`` of
    0-based ranks.  Returns the groups (``by + [n, __ends]``) and the keys ``by +
    [rank, v, i]``; ranks outside 0..n-1 have none."""
    by = list(by)
    # first digits of 18 bits: sign, exponent and six bits more
    h = rows.groupBy(*by, F.shiftright("__v", FIRST).alias("__d")).agg(*_span_aggs())
    w = Window.partitionBy(*by).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("__from", F.coalesce(F.sum("n").over(w), F.lit(0)))  # 2^18 rows at most in a window
    first = ends(h.groupBy(*by).agg(F.sum("n").alias("n"), F.collect_list(F.struct("__from", F.struct("n", *_SPANS).alias("h"))).alias("__hs")))
    ranks = F.filter(F.array_distinct("__ends"), lambda r: (r >= 0) & (r < F.col("n")))
    first = first.select(*by, F.col("n").alias("__n"), "__ends", "__hs", F.explode_outer(ranks).alias("rank"))
    mine = F.get(F.filter("__hs", lambda x: F.col("rank").between(x["__from"], x["__from"] + x.h.n - 1)), F.lit(0))
    first = first.select(*by, "__n", "__ends", "rank", mine.alias("__m")).select(*by, "__n", "__ends", "rank", "__m.__from", "__m.h.*")
    first = first.select(*by, "__n", "__ends", "rank", F.struct(*_interval(F.col("__from"))).alias("at"))
    sizes = first.groupBy(*by).agg(F.max("__n").alias("n"), F.max("__ends").alias("__ends"), _collected().alias("want"))
    groups, left = _pinned(sizes)
    sizes = groups
    while left:
        r = _within(rows, groups, by, lambda w: _open(w.at))
        code = F.when(F.col("x.tied"), F.col("__i")).otherwise(F.col("__v"))
        digit = F.call_function("shiftright", code, F.col("x.shift"))
        h = r.groupBy(*by, "x", digit.alias("__d")).agg(*_span_aggs())
        # one row per digit of an interval: at most DIGITS in a window
        w = Window.partitionBy(*by, "x").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("__from", F.col("x.below") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        found = match(_wanted(groups, by), h.withColumnRenamed("x", "at"), [*by, "at"], "left")
        found = found.filter(F.col("n").isNull() | F.col("rank").between(F.col("__from"), F.col("__from") + F.col("n") - 1))
        now = F.when(F.col("n").isNull(), F.col("at")).otherwise(F.struct(*_interval(F.col("__from"))))
        groups, left = _pinned(found.select(*by, "rank", now.alias("at")).groupBy(*by).agg(_collected().alias("want")))
    # small intervals: at most SMALL rows in a window
    r = _within(rows, groups, by, lambda w: _small(w.at))
    w = Window.partitionBy(*by, "x").orderBy("__v", "__i")
    r = r.select(*by, (F.col("x.below") + F.row_number().over(w) - 1).alias("rank"), F.col("__v").alias("v"), F.col("__i").alias("i"))
    wanted = _wanted(groups, by)
    direct = match(r, wanted.select(*by, "rank"), [*by, "rank"], "left_semi")
    tied = wanted.filter("at.tied and at.lo = at.hi").select(*by, "rank", F.col("at.v0").alias("v"), F.col("at.lo").alias("i"))
    return sizes.select(*by, "n", "__ends"), direct.select(*by, "rank", "v", "i").unionByName(tied)


def keyed(df: DataFrame, value, id_col=None) -> DataFrame:
    """``df`` with the codes of value and id; an id that is no whole number goes by its hash."""
    ident = F.lit(0) if id_col is None else c(id_col)
    if not isinstance(df.select(ident).schema[0].dataType, T.IntegralType):
        ident = F.xxhash64(ident)
    ident = ident.cast("bigint")
    return with_order_code(df, value, "__v").withColumn("__i", F.coalesce(ident, F.lit(-(1 << 63))))


def medians(df: DataFrame, cols, by=None) -> DataFrame:
    """A2: exact medians of the non-null values of several columns, one row per group."""
    by = list(by or [])
    names = F.array(*[F.struct(F.lit(x).alias("__col"), F.col(x).cast("double").alias("__x")) for x in cols])
    long = df.select(*by, F.explode(names).alias("__e")).select(*by, "__e.__col", "__e.__x").filter("__x is not null")
    keys = [*by, "__col"]
    _, at = rank_keys(keyed(long, "__x").select(*keys, "__v", "__i"), keys,
                      lambda g: g.withColumn("__ends", F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))))
    mid = at.groupBy(*keys).agg(F.avg(order_value("v")).alias("__m"))
    return mid.groupBy(*by).agg(*[F.max(F.when(F.col("__col") == x, F.col("__m"))).alias(x) for x in cols])
