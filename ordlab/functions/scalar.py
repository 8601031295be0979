"""Column-expression helpers (F1-F20).  All of them build JVM-side Catalyst
expressions, so they stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uniform(cols, seed: int) -> Column:
    """A repeatable number in [0, 1) for each row: 52 bits of a hash of the
    columns and the seed (the same for any partitioning and any retry)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return F.pmod(F.xxhash64(*[F.col(x) for x in cols], F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def guarded_ratio(num, den) -> Column:
    """``num/den`` and 0 where the divisor is 0 (or null)."""
    d = c(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(c(num).cast("double"), d.cast("double")))


def safe_div(num, den) -> Column:
    """``num / nullif(den, 0)``: null instead of an ANSI divide-by-zero error."""
    return c(num).cast("double") / F.nullif(c(den).cast("double"), F.lit(0.0))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(x)))


def clamp(x, lo: float, hi: float) -> Column:
    """F10; null stays null (Spark's greatest/least skip nulls, so guard)."""
    v = c(x)
    return F.when(v.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


_TINY = 2.0 ** -1022  # the least normal double
_STEPS = 1 << 52  # doubles between a power of two and the next


def with_order_code(df: DataFrame, x, out: str) -> DataFrame:
    """Add a bigint that orders doubles as Spark does: null first, then numbers
    (0.0 and -0.0 are one), then NaN; the distance of two codes is the number
    of doubles between them.  Codes of numbers are exact and ``order_value``
    gives the number back.  Each step is a column, so that none is computed twice."""
    v, a, e, m, p, q = (F.col(f"__oc_{k}") for k in "vaempq")
    steps = {"v": c(x).cast("double"), "a": F.abs(v),
             "e": F.greatest(F.least(F.floor(F.log2(F.greatest(a, F.lit(_TINY)))), F.lit(1023)), F.lit(-1022)).cast("bigint"),
             "m": a / F.pow(F.lit(2.0), e.cast("double")),  # exact; the logarithm may be one off at a power of two
             "p": F.when(m >= 2, 1).when(m < 1, -1).otherwise(0),
             "q": F.when(p > 0, m / 2).when(p < 0, m * 2).otherwise(m),
             "k": F.when(v.isNull(), F.lit(-(1 << 63))).when(F.isnan(v), F.lit((1 << 63) - 1))
             .when(a == F.lit(float("inf")), F.lit(2047 * _STEPS))
             .when(a < F.lit(_TINY), (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint"))
             .otherwise((e + p + 1023) * F.lit(_STEPS) + ((q - 1) * F.lit(float(_STEPS))).cast("bigint"))}
    k = F.col("__oc_k")  # columns of one select that refer to those before them
    named = [col.alias(f"__oc_{name}") for name, col in steps.items()]
    return df.select("*", *named, F.when(v < 0, -k).otherwise(k).alias(out)).drop(*[f"__oc_{name}" for name in steps])


def order_value(code) -> Column:
    """The double of an ``order_code`` (null for null's code)."""
    k = c(code)
    a = F.abs(F.when(k > F.lit(-(1 << 63)), k))
    f = a % F.lit(_STEPS)
    e = (a - f) / F.lit(_STEPS)
    small = f.cast("double") * F.lit(2.0 ** -537) * F.lit(2.0 ** -537)
    big = (F.lit(1.0) + f.cast("double") / F.lit(float(_STEPS))) * F.pow(F.lit(2.0), e - 1023)
    out = F.when(a == F.lit((1 << 63) - 1), F.lit(float("nan"))).when(a >= F.lit(2047 * _STEPS), F.lit(float("inf")))
    out = out.when(a < F.lit(_STEPS), small).otherwise(big)
    return F.when(k < 0, -out).otherwise(out)


def half_even(x, scale: int = 0) -> Column:
    """numpy ``round``/``rint``."""
    return F.bround(c(x), scale)


def half_away(x, scale: int = 0) -> Column:
    """F8: the Python-2 builtin ``round``."""
    return F.round(c(x), scale)


def trunc_int(x) -> Column:
    """``int()`` truncates toward zero."""
    return F.when(c(x) < 0, F.ceil(c(x))).otherwise(F.floor(c(x))).cast("bigint")


def softmax(arr, k: int | None = None) -> Column:
    """F11 with a per-row max (Q17).  With a known length ``k`` the scores are
    unrolled into plain expressions (codegen, shared subexpressions); without
    it, array higher-order functions are used."""
    a = c(arr)
    if k:
        xs = [a[i] for i in range(k)]
        m = F.greatest(*xs)
        es = [F.exp(x - m) for x in xs]
        tot = es[0]
        for e in es[1:]:
            tot = tot + e
        return F.array(*[e / tot for e in es])
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def expected_class(probs) -> Column:
    """``sum_k k * p_k`` with classes numbered from 1."""
    p = c(probs)
    return F.aggregate(F.zip_with(p, F.sequence(F.lit(1), F.size(p)), lambda x, k: x * k),
                       F.lit(0.0), lambda acc, x: acc + x)


def row_sum(cols) -> Column:
    """Horizontal sum, null if any input is null."""
    return reduce(add, [c(x) for x in cols])


def row_sum_skip_null(cols) -> Column:
    """Horizontal sum that treats null as 0."""
    return reduce(add, [F.coalesce(c(x), F.lit(0)) for x in cols])


def row_argmax(arr) -> Column:
    """1-based position of the first maximum."""
    a = c(arr)
    return F.array_position(a, F.array_max(a))


def row_vote(cols) -> Column:
    """The most frequent value among ``cols``; ties go to the lowest value."""
    arr = F.array(*[c(x) for x in cols])
    cnt = F.transform(arr, lambda v: F.struct(
        F.size(F.filter(arr, lambda u: u == v)).alias("n"), (-v).alias("neg")))
    best = F.array_max(cnt)
    return -best["neg"]


def code_letter(code) -> Column:
    """First character of a letter+digit code."""
    return F.substring(c(code), 1, 1)


def code_rest(code) -> Column:
    """Characters after the first."""
    return F.expr("substring({0}, 2)".format(code)) if isinstance(code, str) else F.substr(code, F.lit(2))


def json_pick(col, path: str) -> Column:
    """JSON path pick that falls back to the input string."""
    return F.coalesce(F.get_json_object(c(col), path), c(col))


def ts_text(ts) -> Column:
    """``%Y-%m-%d %X``."""
    return F.date_format(c(ts), "yyyy-MM-dd HH:mm:ss")


def split_ints(s, sep: str = ",") -> Column:
    """comma-separated text to an array of bigint."""
    return F.transform(F.split(F.trim(c(s)), sep), lambda x: F.trim(x).cast("bigint"))


def round6(x) -> Column:
    return F.round(c(x).cast("double"), 6)
