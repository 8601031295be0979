"""ST1: the FTRL learner as a Structured Streaming query.

Each micro-batch continues from the model state left by the previous one:
``foreachBatch`` runs the mini-batch steps of ``ordlab.operators.ftrl`` over
the new rows and writes the new state as a table under the shared
checkpoint folder (``<root>/state/batch=<id>``).  The stream's own
checkpoint records which source files were consumed, so a restarted query
sees only the unseen rows.  Batch ``N`` continues from the last state written
before ``N`` and overwrites its own state folder, so a batch that is replayed
after its state was written gives the same state again.

A micro-batch is one source file in most streams, so what it costs apart from its
rows is paid per file: small ones are a count and one job (``ftrl.single_pass``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlab.operators import ftrl
from ordlab.session import checkpoint_dir, materialize


def _latest_state(spark: SparkSession, root: str, before: int | None = None):
    """The last written state (of a batch before ``before``), or None."""
    state_root = os.path.join(root, "state")
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(state_root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if before is not None and fs.exists(jvm.Path(f"{state_root}/batch={before - 1}")):
        last = before - 1
    elif fs.exists(path):
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        done = [int(x[6:]) for x in names if x.startswith("batch=")]
        last = max([x for x in done if before is None or x < before], default=None)
    else:
        last = None  # no micro-batch has written state yet
    return None if last is None else spark.read.parquet(f"{state_root}/batch={last}").drop("batch")


def batch_step(spark: SparkSession, to_long, prm: ftrl.FtrlParams, batch_size: int, root: str):
    """The ``foreachBatch`` function: one micro-batch, one state folder."""

    def on_batch(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        rows = df.persist()
        long = to_long(rows)
        labels = rows.select("id", "y")
        init = _latest_state(spark, root, before=int(batch_id))
        state = ftrl.single_pass(long, labels, prm, batch_size, init)
        if state is None:
            if init is not None:
                # features first seen in this micro-batch start from zero
                new = ftrl.zero_state(long)
                new = new.join(init.select(F.col("feature").alias("__f")), F.col("feature").eqNullSafe(F.col("__f")), "left_anti")
                init = materialize(init.unionByName(new), "stream-state")
            state, _ = ftrl.fit(long, labels, prm, batch_size=batch_size, epochs=1, state=init)
        (state.withColumn("batch", F.lit(int(batch_id)))
              .write.mode("overwrite").parquet(os.path.join(root, "state", f"batch={int(batch_id)}")))
        rows.unpersist()

    return on_batch


def run_stream(spark: SparkSession, source: DataFrame, to_long, prm: ftrl.FtrlParams, batch_size: int,
               name: str = "ftrl", root: str | None = None) -> DataFrame:
    """Run ``source`` (a streaming DataFrame with ``id`` and ``y``) to the end
    with an ``availableNow`` trigger; ``to_long(df)`` turns rows into
    ``(id, feature, value)``.  Returns the final state table."""
    root = root or os.path.join(checkpoint_dir(spark), f"ordlab-stream-{name}")
    q = (source.writeStream.foreachBatch(batch_step(spark, to_long, prm, batch_size, root))
         .option("checkpointLocation", os.path.join(root, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return _latest_state(spark, root)
