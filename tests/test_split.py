"""Holdouts are independent of each other (H1-H3, H6)."""

import itertools

import pytest

from pyspark.sql import functions as F

from ordlab.operators import split


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(60_000).withColumnRenamed("id", "key")


def role_sets(df, key, **kw):
    out = {}
    for r in split.holdout(df, key, **kw).filter("role = 'test'").groupBy("run").agg(F.collect_set(key).alias("s")).collect():
        out[r["run"]] = set(r["s"])
    return out


@pytest.mark.parametrize("strings", [False, True])
def test_shares_and_overlaps(ids, strings):
    df = ids.withColumn("key", F.concat(F.lit("row-"), F.col("key"))) if strings else ids
    sets = role_sets(df, "key", runs=6)
    for s in sets.values():
        assert len(s) / 60_000 == pytest.approx(0.2, abs=0.01)
    for a, b in itertools.combinations(sets.values(), 2):
        assert len(a & b) / 60_000 == pytest.approx(0.04, abs=0.005)
    assert 1 - len(set.union(*sets.values())) / 60_000 == pytest.approx(0.8 ** 6, abs=0.01)


def test_nested_layers_keep_their_share(ids):
    train = split.holdout(ids, "key", runs=1).filter("role = 'train'").drop("run", "role")
    inner = split.holdout(train, "key", runs=1, first_run=2).groupBy("role").count().collect()
    n = {r["role"]: r["count"] for r in inner}
    assert n["test"] / (n["test"] + n["train"]) == pytest.approx(0.2, abs=0.01)


def test_bags_are_independent(ids):
    s = {r["bag"]: set(r["s"]) for r in split.bags(ids, "key", 3, 0.5).filter("role = 'test'").groupBy("bag").agg(F.collect_set("key").alias("s")).collect()}
    for a, b in itertools.combinations(s.values(), 2):
        assert len(a & b) / 60_000 == pytest.approx(0.25, abs=0.01)


def test_folds_are_disjoint_and_even(ids):
    n = [r["count"] for r in split.kfold(ids, "key", 5).groupBy("fold").count().collect()]
    assert len(n) == 5 and sum(n) == 60_000 and max(n) - min(n) < 900


def test_null_id_has_one_role(spark):
    df = spark.createDataFrame([(None,), (1,)], "key bigint")
    assert split.holdout(df, "key", runs=3).count() == 6
    assert split.holdout(df, "key", runs=3).filter("role IS NULL").count() == 0
