"""Small operators without a query of their own."""

import pytest

from pyspark.sql import functions as F

from ordlab.operators import clean, decode, features, frame, ftrl, objectives, split
from ordlab.sources import files, tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, None, 2.5)], "id int, code string, x_val double")


def test_columns_and_rows(spark, small):
    assert frame.columns_like(small, "co") == ["code"] and frame.columns_like(small, regex="^x_") == ["x_val"]
    assert {r["k"] for r in frame.constant(small, "k", 7).collect()} == {7}
    assert [r["id"] for r in frame.rows_without_ids(small, small.filter("id < 3"), "id").collect()] == [3]
    both = frame.union_tagged(small, small.drop("code"))
    assert both.count() == 6 and both.filter("split = 'test' AND code IS NULL").count() == 3
    a, b = frame.split_back(both)
    assert (a.count(), b.count()) == (3, 3)


def test_fill_by_strategy(small):
    got = {r["id"]: r["x_val"] for r in clean.fill_mean_or_value(small, ["x_val"]).collect()}
    assert got == {1: 1.5, 2: 2.0, 3: 2.5}
    assert clean.fill_mean_or_value(small, ["x_val"], -1.0).filter("x_val = -1").count() == 1


def test_one_hot_vector(small):
    got = features.one_hot_vector(small, "code").orderBy("id").collect()
    assert [list(r["code_vec"])[:2] for r in got] == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]


def test_cut_array_is_in_cut_order(spark):
    cuts = spark.createDataFrame([(1, 2, 5.0), (1, 1, 3.0), (2, 1, 9.0)], "run int, k int, cut double")
    assert {r["run"]: r["cuts"] for r in decode.cut_array(cuts, by=["run"]).collect()} == {1: [3.0, 5.0], 2: [9.0]}


def test_files(spark, small, tmp_path):
    path = str(tmp_path / "n.csv")
    files.write_csv(spark.createDataFrame([(1, 2.5), (3, 4.0)], "a int, b double").coalesce(1), path)
    back = files.read_csv_doubles(spark, path, ["a", "b"])
    assert back.dtypes == [("a", "double"), ("b", "double")] and sorted(map(tuple, back.collect())) == [(1.0, 2.5), (3.0, 4.0)]
    folds = split.fold_table(small, "id", runs=2)
    files.write_folds(folds, str(tmp_path / "folds"))
    kept = spark.read.parquet(str(tmp_path / "folds"))
    assert sorted(map(tuple, kept.select("run", "id", "role").collect())) == sorted(map(tuple, folds.select("run", "id", "role").collect()))
    v = spark.range(5000).select("id", (F.col("id") * 0.5).alias("x")).repartition(7)
    files.write_vector(v, str(tmp_path / "v"), "x", ["id"])
    assert files.read_vector(spark, str(tmp_path / "v")).filter("value <> ix * 0.5 OR ix IS NULL").count() == 0
    assert files.read_vector(spark, str(tmp_path / "v")).count() == 5000
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "v.txt").write_text("0.25\n0.5\n")
    assert [(r["ix"], r["value"]) for r in files.read_vector(spark, str(tmp_path / "old")).collect()] == [(0, 0.25), (1, 0.5)]


def test_views_and_registry(spark, small):
    tables.register_views(spark, SF_SMALL, ["nation", "region"])
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25
    rows = spark.createDataFrame([(1, 2, [0.1] * 8), (2, 5, [0.3] * 8)], "id int, y int, s array<double>")
    for name, build in objectives.REGISTRY.items():
        if name != "pseudo_huber":
            assert build(rows, "id", "y", "s").count() == 16


def test_one_vs_rest_targets(spark):
    labels = spark.createDataFrame([(1, 2), (2, 1)], "id int, y int")
    got = {r["id"]: r["y"] for r in ftrl.one_vs_rest_long(labels, [1, 2]).collect()}
    assert got == {"1#1": 0.0, "1#2": 1.0, "2#1": 1.0, "2#2": 0.0}
