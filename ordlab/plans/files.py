"""Source/sink and string-function queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ordlab.functions.scalar import json_pick, ts_text
from ordlab.operators.split import fold_table
from ordlab.plans.catalog import T, query
from ordlab.plans.standins import SQL_SPLIT_KEY
from ordlab.session import checkpoint_dir
from ordlab.sources import files


def _scratch(spark, tag):
    return os.path.join(checkpoint_dir(spark), f"ordlab-{tag}-{uuid.uuid4().hex}")


@query("json_fallback", """
select event_id, coalesce(json_extract_string(props, '$.trans_result[0].dst'), props) dst,
       json_extract_string(props, '$.k') k, strftime(ts, '%Y-%m-%d %H:%M:%S') ts_text
from events""")
def q_json_fallback(spark, sf):
    """JSON path pick with fall-back to the input, and the
    ``%Y-%m-%d %X`` timestamp text."""
    e = T(spark, sf, "events")
    return e.select("event_id", json_pick("props", "$.trans_result[0].dst").alias("dst"),
                    F.get_json_object("props", "$.k").alias("k"), ts_text("ts").alias("ts_text"))


@query("csv_roundtrip", "select n_nationkey, n_name, n_regionkey from nation")
def q_csv_roundtrip(spark, sf):
    """Write a table as headed CSV to the shared folder and scan it
    back with an explicit schema."""
    path = _scratch(spark, "csv")
    files.write_csv(T(spark, sf, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("fold_file_roundtrip", f"""
with r as (select cast(unnest(generate_series(1, 6)) as integer) run)
select r.run, case when {SQL_SPLIT_KEY.format(run='r.run', id='o.o_orderkey')} < 2000 then 'test' else 'train' end role,
       o.o_orderkey id from orders o, r""")
def q_fold_file_roundtrip(spark, sf):
    """Six holdouts written as legacy comma-separated id lines (one
    folder per run and role, bounded lines) and read back."""
    folds = fold_table(T(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", runs=6)
    path = _scratch(spark, "folds")
    files.write_fold_lines(folds, path, ids_per_line=1000)
    back = files.read_fold_lines(spark, path)
    return back.select(F.col("run").cast("int"), "role", "id")
