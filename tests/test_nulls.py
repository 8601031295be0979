"""Null ratings, scores, groups and labels have defined results."""

import pytest

from pyspark.sql import functions as F

from ordlab.operators import clean, features, metrics, models, rank, select
from ordlab.operators import decode as dc

COMPLETE = [(1, 1, 2), (2, 2, 2), (3, 3, 4), (4, 4, 3)]


@pytest.mark.parametrize("kappa", [metrics.qwk, metrics.linear_kappa, metrics.cohen_kappa])
def test_kappas_use_complete_pairs_only(spark, kappa):
    schema = "id int, a int, b int"
    whole = kappa(spark.createDataFrame(COMPLETE, schema), "a", "b").first()["kappa"]
    gaps = spark.createDataFrame(COMPLETE + [(5, None, 4), (6, 1, None), (7, None, None)], schema)
    assert kappa(gaps, "a", "b").first()["kappa"] == pytest.approx(whole)
    by = gaps.withColumn("g", F.when(F.col("id") <= 5, "x").otherwise("y"))
    assert {r["g"]: r["kappa"] for r in kappa(by, "a", "b", by=["g"]).collect()} == {"x": pytest.approx(whole)}


def test_cut_decode_of_null_and_nan(spark):
    df = spark.createDataFrame([(0, None), (1, float("nan")), (2, 0.5), (3, 9.0)], "id int, s double")
    for cuts in ([1.5, 2.5], F.array(F.lit(1.5), F.lit(2.5))):
        got = {r["id"]: r["c"] for r in df.select("id", dc.decode_cut("s", cuts).alias("c")).collect()}
        assert got == {0: None, 1: None, 2: 1, 3: 3}


def test_positions_of_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id int, g string")
    got = {r["id"]: (r["pos"], r["n"]) for r in rank.position(df, ["id"], "pos", partition_by=["g"], with_count="n").collect()}
    assert got == {1: (0, 2), 2: (1, 2), 3: (0, 2), 4: (1, 2)}


def test_fills_and_scaling_of_null_groups(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, "a", 4.0), (4, "a", None), (5, None, 4.0)], "id int, g string, x double")
    for fill, want in ((clean.fill_mean, 3.0), (clean.fill_median, 3.0)):
        got = {r["id"]: r["x"] for r in fill(df, ["x"], by=["g"]).collect()}
        assert got == {1: 2.0, 2: want, 3: 4.0, 4: 4.0, 5: 4.0}
    got = {r["id"]: r["x"] for r in features.standardize(df, ["x"], by=["g"]).collect()}
    assert got == {1: -1.0, 2: None, 3: None, 4: None, 5: 1.0}


def test_constant_label_has_no_f_score(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0) for i in range(9)], "x double, k double, y double")
    assert {r["feature"]: r["f_score"] for r in select.f_scores(df, ["x", "k"], "y").collect()} == {"x": None, "k": None}


def test_boosted_one_vs_rest_has_probabilities(spark):
    df = spark.createDataFrame([(float(i % 60), float(i % 7), i % 60 // 20 + 1) for i in range(240)], "a double, b double, y int")
    kinds = [models.class_probabilities(df, ["a", "b"], "y", kind, n_classes=3) for kind in ("gbt_ovr", "rf")]
    got = models.stack_probabilities(kinds, df, n_classes=3).collect()
    assert len(got) == 240
    right = 0
    for r in got:
        p = [r[f"stack_p{k}"] for k in (1, 2, 3)]
        assert sum(p) == pytest.approx(1.0) and min(p) >= 0
        right += p.index(max(p)) + 1 == r["y"]
    assert right > 0.95 * len(got)


def test_replayed_batch_gives_the_same_state(spark, tmp_path):
    """ST1: batch 1 again, after its state was written."""
    from ordlab.operators import ftrl
    from ordlab.streaming import ftrl_stream as fs
    rows = spark.createDataFrame([(i, float(i % 3 == 0), [1.0, i / 40]) for i in range(40)], "id int, y double, x array<double>")

    def to_long(df):
        return df.select("id", F.posexplode("x").alias("f", "value")).select("id", F.concat(F.lit("f"), F.col("f")).alias("feature"), "value")

    step = fs.batch_step(spark, to_long, ftrl.FtrlParams(link="logistic", alpha=0.5), 10, str(tmp_path))
    step(rows.filter("id < 20"), 0)
    step(rows.filter("id >= 20"), 1)

    def state():
        return {r["feature"]: pytest.approx((r["z"], r["n"], r["w"])) for r in fs._latest_state(spark, str(tmp_path)).collect()}

    once = state()
    step(rows.filter("id >= 20"), 1)
    assert {r["feature"]: (r["z"], r["n"], r["w"]) for r in fs._latest_state(spark, str(tmp_path)).collect()} == once


def test_ridge_per_group_for_any_number_of_groups(spark):
    """150 groups and a null group, against the normal equations."""
    import numpy as np
    r, rows = np.random.default_rng(0), []
    for g in range(151):
        for _ in range(12):
            a, b = r.normal(size=2)
            rows.append((len(rows), g if g else None, float(a), float(b), float(a * g - b + r.normal())))
    rows += [(len(rows) + g, g or None, 0.5, -0.5, None) for g in range(151)]
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, y double")
    got = {x["id"]: x["y_filled"] for x in clean.impute_ridge_multi(df, ["a", "b"], "y", 0.3, by="g").collect()}
    assert len(got) == len(rows)
    for g in range(151):
        part = np.array([x[2:] for x in rows[12 * g:12 * g + 12]], float)
        x, y = part[:, :2], part[:, 2]
        z = x - x.mean(0)
        norm = np.sqrt((z ** 2).sum(0))
        w = np.linalg.solve((z / norm).T @ (z / norm) + 0.3 * np.eye(2), (z / norm).T @ (y - y.mean())) / norm
        assert got[12 * 151 + g] == pytest.approx(y.mean() + (np.array([0.5, -0.5]) - x.mean(0)) @ w)
