"""Positional operators without a single-task window.

A global ``row_number()`` over an un-partitioned window moves every row into
one task.  ``position`` instead range-partitions on the ordering keys, sorts
inside each partition and numbers rows with ``monotonically_increasing_id``
(partition index in the high bits, row offset in the low 33 bits), and pins
the numbered rows in the shared checkpoint folder.  The only data that is
ever combined in one place is the per-partition row count — one number per
shuffle partition — whose prefix sums become a constant array in the plan.

Group-relative positions (``partition_by``) subtract the group's first global
position, found with a partial aggregate, so a hot group that holds a third of
the rows is still spread over many range partitions instead of one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordlab.session import fitted, materialize, shuffle_partitions

_LOW_BITS = (1 << 33) - 1


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def position(df: DataFrame, order_by, out: str = "pos", partition_by=None,
             with_count: str | None = None, num_partitions: int | None = None, keep=None) -> DataFrame:
    """Add a 0-based position of each row in ``order_by`` order.

    ``order_by`` must be a total order (end it with a unique id); ties are not
    broken arbitrarily.  With ``partition_by`` the position restarts at 0 in
    every group and ``with_count`` optionally adds the group size.  ``keep`` names
    the columns wanted after the sort (with those of ``partition_by``); others are not written.
    """
    spark = df.sparkSession
    parts = list(partition_by or [])
    keys = _cols(parts) + _cols(order_by)
    n = num_partitions or shuffle_partitions(spark)
    ranged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("__pid", F.spark_partition_id())
                .withColumn("__local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    if keep is not None:
        ranged = ranged.select(*keep, "__pid", "__local")
    # The range bounds come from a sample whose outcome depends on the input
    # order, so the numbered rows are written once to the shared checkpoint
    # folder: counts and offsets are then read from the same rows.
    ranged = materialize(ranged, "position")
    # one count per shuffle partition (bounded by the partition count, not the
    # data): prefix-summed on the driver and applied as a constant array lookup
    counts = dict(ranged.groupBy("__pid").agg(F.count(F.lit(1))).collect())
    offsets, acc = [], 0
    for pid in range(max([n] + [k + 1 for k in counts])):
        offsets.append(acc)
        acc += int(counts.get(pid, 0))
    off = F.array(*[F.lit(o) for o in offsets])[F.col("__pid")]
    out_df = ranged.withColumn(out, off + F.col("__local"))
    if not parts:
        if with_count:
            out_df = out_df.withColumn(with_count, F.lit(acc).cast("bigint"))
        return out_df.drop("__pid", "__local")
    out_df = out_df.drop("__pid", "__local")
    aggs = [F.min(out).alias("__start")]
    if with_count:
        aggs.append(F.count(F.lit(1)).alias(with_count))
    starts = fitted(out_df.groupBy(*parts).agg(*aggs), "group-starts")
    part_names = [p if isinstance(p, str) else None for p in parts]
    if any(p is None for p in part_names):
        raise ValueError("partition_by must be column names")
    from ordlab.operators.frame import match
    return (match(out_df, starts, part_names, "inner")
            .withColumn(out, F.col(out) - F.col("__start"))
            .drop("__start"))


def window_position(df: DataFrame, order_by, out: str = "pos", partition_by=None) -> DataFrame:
    """Plain ``row_number()-1`` window; for inputs of bounded size only
    (class tables, trial logs, distinct-value lists)."""
    w = Window.orderBy(*_cols(order_by))
    if partition_by:
        w = Window.partitionBy(*_cols(partition_by)).orderBy(*_cols(order_by))
    return df.withColumn(out, F.row_number().over(w) - 1)


def batches(df: DataFrame, order_by, batch_size: int, out: str = "batch") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows by position."""
    return (position(df, order_by, "__p")
            .withColumn(out, F.floor(F.col("__p") / F.lit(batch_size)).cast("bigint"))
            .drop("__p"))


def ordered_split(df: DataFrame, order_by, train_fraction: float, out: str = "role") -> DataFrame:
    """First ``floor(train_fraction * n)`` rows are train, the rest test."""
    p = position(df, order_by, "__p", with_count="__n")
    return (p.withColumn(out, F.when(F.col("__p") < F.floor(F.col("__n") * F.lit(float(train_fraction))),
                                     F.lit("train")).otherwise(F.lit("test")))
            .drop("__p", "__n"))


def rows_between(df: DataFrame, order_by, first: int, last: int) -> DataFrame:
    """P10: rows whose 0-based position lies in ``[first, last]``."""
    return position(df, order_by, "__p").filter(F.col("__p").between(first, last)).drop("__p")
