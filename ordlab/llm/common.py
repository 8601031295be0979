"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlab.session import checkpoint_dir, materialize, shuffle_partitions  # noqa: F401
from ordlab.sources.tables import table  # noqa: F401


def narrow(df: DataFrame, **cols: str | Column) -> DataFrame:
    """Select columns under internal names, so that columns of ``df`` with
    clashing names never meet the operator's own."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in cols.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as keep them apart from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder name (a URI) under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ordlab-{tag}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """Arrow file system and path of a URI or plain path; tasks read and write
    non-Parquet files through it, so any store that Arrow knows will do."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_bytes(folder: str, name: str, chunks) -> int:
    """Write the byte chunks to a file under a name of its own attempt and
    return its size.  A task that is run again writes another file; only files
    named by the manifest are ever read."""
    f, path = filesystem(folder)
    f.create_dir(path, recursive=True)
    n = 0
    with f.open_output_stream(f"{path}/{name}", compression=None) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    return n


FILTER_BITS = 1 << 25  # 4 MB


def bitmap(keys: DataFrame, col: str):
    """Broadcast bitmap of ``FILTER_BITS`` bits of 64-bit keys.  Its size is
    fixed: more keys let more rows pass, and an exact join always follows."""
    schema = pa.schema([("bits", pa.binary())])

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy(zero_copy_only=False) & (FILTER_BITS - 1)] = True
        yield batch(schema, [np.packbits(bits, bitorder="little").tobytes()])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in keys.select(col).coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r[0], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def hits(bits, keys):
    """Which 64-bit keys (a numpy array) the bitmap lets pass."""
    slot = keys.view("uint64") & (FILTER_BITS - 1)
    return (bits.value[(slot >> 3).astype("int64")] >> (slot & 7).astype("uint8") & 1).astype(bool)


def may_contain(bits):
    """``hits`` as a column function."""
    @F.pandas_udf("boolean")
    def udf(key: pd.Series) -> pd.Series:
        return pd.Series(hits(bits, key.to_numpy("int64")))

    return udf


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


def pin(df: DataFrame, tag: str) -> DataFrame:
    """``materialize`` with Zstandard-compressed files, for wide tables."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
