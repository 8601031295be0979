"""Sharding by sampled splitters (operator 10).

Records are ordered by the key (hash of the text, doc_id, a number of the row), so
equal texts lie next to each other.  A size-weighted sample of keys (those with
``-ln(u) / size < m / total``, ``m`` in expectation) gives quantile boundaries.
Their exact bytes show which ranges are overfull (more than ``OVERFULL`` times a
range's share); each of these is sampled again inside and subdivided, until none is
overfull or what is left is a single record.  Exact bytes and rows of the ranges,
then a running sum of bytes inside each range, place every record.

Law ``bytes``: shard ``s`` takes what has its middle byte in the ``s``-th of
``n_shards`` equal parts of all bytes.  That is a group of equal texts (its part in
one range) of at most ``1 / WHOLE`` of a shard's share, so that no boundary falls
inside it; larger groups are cut, record by record.  Shard sizes hence differ by a
hundredth of a share or one record at most.  What the driver holds is the sample and
one row per range: ``n_ranges`` of them, by default one for each ``ROWS_PER_RANGE``
records, 32 a shard at least.

Null text: no bytes, size 8, crc32 of nothing.  Null doc_id: sorts first.  Rows
that repeat doc_id and text are interchangeable, and any number of them spreads
over ranges.  An empty table gives no rows.  Extra columns are kept by
``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordlab.llm.common import fresh, materialize, narrow

SAMPLE_PER_RANGE = 16
ROWS_PER_RANGE = 1 << 20
OVERFULL = 4
WHOLE = 100
NULL_ID = -(1 << 63)
KEY = ("h", "ident", "row")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keys and sizes, written once: ``row`` tells equal records apart from then on."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = narrow(docs, doc_id=id_col, size=(F.octet_length(t) + 8).cast("bigint"),
                  text_crc32=F.crc32(F.encode(t, "UTF-8")), h=F.xxhash64(t),
                  ident=F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)))
    return materialize(keys.withColumn("row", F.monotonically_increasing_id()), "shard-keys")


def splitters(keys: DataFrame, parts: dict[int, tuple[int, int]], seed: int) -> np.ndarray:
    """Boundaries inside ranges.  ``parts``: range -> (its bytes, the number of parts
    wanted); from each a size-weighted sample of ``SAMPLE_PER_RANGE`` keys a part.  A
    record of more than a part's bytes gets a part of its own."""
    rate = keys.sparkSession.createDataFrame([(r, n * SAMPLE_PER_RANGE / b) for r, (b, n) in parts.items()], "r int, rate double")
    u = (F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    some = keys.join(F.broadcast(rate), "r").filter(-F.log(u) / F.col("size") < F.col("rate"))  # a row per range
    drawn: dict[int, list] = {}
    for r, size, *key in some.select("r", "size", *KEY).collect():
        drawn.setdefault(r, []).append((*key, size))
    out = set()
    for r, got in drawn.items():
        b, n = parts[r]
        got.sort()
        out |= {got[i][:-1] for i in (np.arange(1, n) * len(got)) // n}
        for h, ident, row, size in got:
            if size * n > b:
                out |= {(h, ident, row), (h, ident, row + 1)}
    return np.array(sorted(out), np.int64).reshape(-1, len(KEY))


def boundaries_up_to(bounds: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
    """Number of sorted boundaries at or before each key."""
    lo, hi = (np.searchsorted(bounds[:, 0], cols[0], side) for side in ("left", "right"))
    if len(cols) == 1:
        return hi
    out = lo.copy()
    for a in np.unique(lo[lo < hi]):  # keys on a boundary: the next part of the key decides
        rows = (lo == a) & (hi > a)
        b = int(hi[rows][0])
        out[rows] = a + boundaries_up_to(bounds[a:b, 1:], [c[rows] for c in cols[1:]])
    return out


def with_range(keys: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``keys`` with the number ``r`` of their range."""
    @F.pandas_udf("int")
    def udf(h: pd.Series, ident: pd.Series, row: pd.Series) -> pd.Series:
        cols = [c.to_numpy(np.int64) for c in (h, ident, row)]
        return pd.Series(boundaries_up_to(bounds, cols).astype(np.int32))

    return keys.withColumn("r", udf(*KEY))


def ranges(keys: DataFrame, n_ranges: int, total: int, seed: int = 7) -> tuple[DataFrame, list]:
    """Keys with their range ``r``, and (range, bytes, rows) of every range: first all
    keys are one range, then overfull ranges are subdivided until none is left."""
    bounds, share = np.zeros((0, len(KEY)), np.int64), total / n_ranges
    while True:
        dealt = with_range(keys, bounds)
        per = sorted(dealt.groupBy("r").agg(F.sum("size"), F.count(F.lit(1))).collect())  # a row per range
        over = {r: (b, -(-b // max(int(share), 1))) for r, b, n in per if n > 1 and b > OVERFULL * share}
        if not over:
            return dealt, per
        seed += 1
        bounds = np.unique(np.concatenate([bounds, splitters(dealt, over, seed)]), axis=0)


def place(docs: DataFrame, n_shards: int = 24, n_ranges: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every record."""
    spark = docs.sparkSession
    keys = _keys(docs, id_col, text_col)
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    keys, per = ranges(keys, n_ranges or max(n_shards * 32, -(-rows // ROWS_PER_RANGE)), total)
    b0, n0, start = 0, 0, []
    for r, b, n in per:
        start.append((int(r), b0, n0))
        b0, n0 = b0 + int(b), n0 + int(n)
    base = spark.createDataFrame(start, "r int, b0 bigint, n0 bigint")
    w, unit = Window.partitionBy("r").orderBy(*KEY), Window.partitionBy("r", "h")
    placed = keys.join(F.broadcast(base), "r").select(  # a row per range: n_ranges at most
        "doc_id", "size", "text_crc32", "r", "h",
        (F.col("b0") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
        (F.col("n0") + F.row_number().over(w) - 1).alias("pos"))
    placed = placed.withColumns({"group": F.sum("size").over(unit), "group_before": F.min("before").over(unit)})
    together = F.col("group") * (n_shards * WHOLE) <= total
    twice = F.when(together, F.col("group_before") * 2 + F.col("group")).otherwise(F.col("before") * 2 + F.col("size"))
    mid = twice.cast("decimal(38,0)") * n_shards
    placed = placed.withColumn("shard", F.least(F.floor(mid / F.lit(2 * max(total, 1))), F.lit(n_shards - 1)).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "pos"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))
    return (placed.join(F.broadcast(first), "shard")  # n_shards rows
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("pos") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, n_ranges: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all columns of ``docs`` in folders ``__shard=N`` with their
    ``__slot`` (with more underscores if ``docs`` has such columns), and return the table as read back.  Rows are matched by doc_id
    and text checksum; rows equal in both are interchangeable and are written
    once for each of them."""
    ident, crc, k, pid, pcrc, pk, shard, slot = fresh(docs, "_id", "_crc", "_k", "_pid", "_pcrc", "_pk", "__shard", "__slot")
    keyed = docs.withColumns({ident: F.col(f"`{id_col}`"), crc: F.crc32(F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8"))})
    keyed = keyed.withColumn(k, F.row_number().over(Window.partitionBy(ident, crc).orderBy(F.lit(0))))
    p = place(docs, n_shards, n_ranges, id_col, text_col).select(
        F.col("doc_id").alias(pid), F.col("text_crc32").alias(pcrc), F.col("shard").alias(shard), F.col("slot").alias(slot))
    p = p.withColumn(pk, F.row_number().over(Window.partitionBy(pid, pcrc).orderBy(shard, slot)))
    out = keyed.join(p, F.col(ident).eqNullSafe(F.col(pid)) & (F.col(crc) == F.col(pcrc)) & (F.col(k) == F.col(pk)))
    (out.drop(ident, crc, k, pid, pcrc, pk).repartition(shard, F.pmod(F.col(slot), F.lit(8)))
        .write.partitionBy(shard).parquet(path))
    return docs.sparkSession.read.parquet(path)
