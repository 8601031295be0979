"""Session defaults and the lineage-cutting checkpoint location."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ordlab", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with ordlab's defaults.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is.  Only when the
    setting is absent and the master is local (tests) a private scratch folder
    is created, and deleted when the process ends.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ordlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` has written in this process; call
    it when no result that reads them is needed any more."""
    hadoop, n = spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(hadoop).delete(path, True))
    return n


def materialize(df, tag: str = "stage", partition_by=None):
    """Write ``df`` to a fresh folder under the shared checkpoint location and
    read it back: cuts lineage and pins the data, so every later use (and any
    recomputation after an executor loss) sees exactly the same rows.
    ``partition_by`` writes one folder per value so later filters prune."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"ordlab-{tag}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    _written.append(path)
    return spark.read.parquet(path)


#: rows of a task of ``dealt``
TASK_ROWS = 1 << 16


def dealt(df, key: str | None = None, task_rows: int = TASK_ROWS):
    """``df`` dealt by the hash of ``key`` (or in turn) into tasks of about ``task_rows`` rows.
    A table in few row groups comes as so few tasks, however many rows they
    hold, and every pass of a fit over it would then run on those alone.  Small
    tables are dealt over the cores, but not into tasks of under a sixteenth."""
    rows = df.count()
    tasks = max(-(-rows // task_rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-16 * rows // task_rows)), 1)
    return df.repartition(tasks, key) if key else df.repartition(tasks)


def fitted(df, tag: str = "fitted"):
    """Pin a fitted aggregate (per-group statistics, codes, CDFs) as a table
    whose size the planner knows: it is written to the shared checkpoint folder
    and its size there decides between a broadcast and a shuffle join with AQE
    skew splitting."""
    return materialize(df, tag)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
