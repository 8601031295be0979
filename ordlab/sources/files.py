"""File sources and sinks.

Every reader takes an explicit schema (no inference on the hot path) and
every writer is a distributed DataFrame write; the legacy one-line formats of
the reference are read by splitting and exploding lines, and written in
bounded-size lines so no task ever builds one unbounded string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordlab.functions.scalar import split_ints


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV scan with a header and an explicit schema."""
    return spark.read.schema(schema).option("header", header).csv(path)


def read_csv_doubles(spark: SparkSession, path: str, columns) -> DataFrame:
    """CSV scan with every column forced to double."""
    schema = T.StructType([T.StructField(c, T.DoubleType(), True) for c in columns])
    return read_csv(spark, path, schema)


def write_csv(df: DataFrame, path: str, row_number_col: str | None = None, order_by=None) -> None:
    """CSV sink with a header; ``row_number_col`` adds an explicit
    0-based row number in ``order_by`` order (computed without a single-task window)."""
    if row_number_col:
        from ordlab.operators.rank import position
        df = position(df, order_by, row_number_col)
        df = df.select(row_number_col, *[c for c in df.columns if c != row_number_col])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_folds(folds: DataFrame, path: str) -> None:
    """S5 primary form: ``(run, id, role)`` Parquet partitioned by run."""
    folds.write.mode("overwrite").partitionBy("run").parquet(path)


def write_fold_lines(folds: DataFrame, path: str, ids_per_line: int = 10000) -> None:
    """S5 legacy text: comma-separated ids, one folder per (run, role); a line
    holds at most ``ids_per_line`` ids (the reader accepts any number of lines)."""
    from ordlab.operators.rank import position
    p = position(folds, ["run", "role", "id"], "__p", partition_by=["run", "role"])
    lines = (p.groupBy("run", "role", F.floor(F.col("__p") / F.lit(ids_per_line)).alias("__line"))
              .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("__p", "id"))),
                                                lambda s: s["id"].cast("string"))).alias("value")))
    lines.select("run", "role", "value").write.mode("overwrite").partitionBy("run", "role").text(path)


def read_fold_lines(spark: SparkSession, path: str) -> DataFrame:
    """Legacy fold text -> ``(run, role, id)``."""
    t = spark.read.text(path)  # partition columns run, role are discovered from the folder names
    return t.select("run", "role", F.explode(split_ints("value")).alias("id"))


def write_vector(df: DataFrame, path: str, value: str, order_by) -> None:
    """One number per line with its position before it, in part files; of
    any length.  A vector of the legacy form (numbers alone, one file) can be
    read by ``read_vector`` too."""
    from ordlab.operators.rank import position
    v = position(df.select(F.col(value).cast("double").alias("__value"), *order_by), order_by, "__ix")
    v.select(F.concat_ws(" ", F.col("__ix").cast("string"), F.coalesce(F.col("__value").cast("string"), F.lit(""))).alias("value")) \
        .write.mode("overwrite").text(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """``(value, ix)`` with the 0-based position; a line without a position
    (legacy form) is numbered by its place in its one file."""
    t = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id())
    part = F.split("value", " ", 2)
    keyed = F.col("value").contains(" ")
    number = F.when(keyed, part[1]).otherwise(F.col("value"))
    return t.select(F.nullif(number, F.lit("")).cast("double").alias("value"),
                    F.when(keyed, part[0].cast("bigint")).otherwise(F.col("__at")).alias("ix"))


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Svmlight sink (Spark's ``libsvm`` format)."""
    df.select(label, features).write.mode("overwrite").format("libsvm").save(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", num_features)
    return r.load(path)


def append_trials(trials: DataFrame, path: str) -> None:
    """Trial log, appended per search."""
    trials.write.mode("append").parquet(path)


def write_predictions(pred: DataFrame, path: str, partition_by=("run", "model")) -> None:
    """One prediction table (raw, rank, class by CDF, class by cut)
    partitioned so later reads prune by run and model."""
    cols = [c for c in partition_by if c in pred.columns]
    w = pred.write.mode("overwrite")
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small report tables as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def feature_map(df: DataFrame, features) -> DataFrame:
    """``(ix, name, type)``: ``q`` for double columns, ``i`` for 0/1 ints, ``int`` otherwise."""
    spark = df.sparkSession
    types = dict(df.dtypes)
    rows = [(i, f, "q" if types[f] in ("double", "float") else "int") for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "ix int, name string, type string")


def save_model(model, path: str) -> None:
    """``pyspark.ml`` persistence."""
    model.write().overwrite().save(path)


def write_sparse(long: DataFrame, path: str) -> None:
    """Sparse matrix as long ``(row, col, value)`` Parquet."""
    long.write.mode("overwrite").parquet(path)


def template_fill(template: DataFrame, pred: DataFrame, key: str, column: str) -> DataFrame:
    """Replace one column of a submission template by joining the
    predictions on the key (not by position)."""
    return template.drop(column).join(pred.select(key, column), key, "left") \
        .select(*template.columns)
