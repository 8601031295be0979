"""Every registered query against its DuckDB oracle on the smallest tables,
plus bound checks for the model queries (which have no SQL)."""

import os
import sys

import pytest

from tests.conftest import SF_MID, SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_registered_has_callable():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 90


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, QUERIES[key], SQL[key], SF_SMALL)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 6 and set(df.columns) == {"run", "n_test", "kappa"}


MODEL_QUERIES = ["ridge", "lasso", "poisson_glm", "linear_models", "forest", "softmax_clf", "ordinal_ebc_fit",
                 "ordinal_cocr_fit", "leaf_linear"]


@pytest.mark.parametrize("key", MODEL_QUERIES)
def test_model_query_bounds(spark, key):
    """Each model's test RMSE is finite and kappa lies in [-1, 1]."""
    rows = QUERIES[key](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        assert r["rmse"] is not None and r["rmse"] >= 0
        assert r["kappa"] is None or -1 <= r["kappa"] <= 1


def test_forest_beats_constant_predictor(spark):
    """On sf0.01 the forests are better than predicting the test mean."""
    from pyspark.sql import functions as F
    from ordlab.plans.learners import wide
    w = wide(spark, SF_MID).filter(F.col("split") == "test")
    const_rmse = w.agg(F.stddev_pop("yd")).first()[0]
    for r in QUERIES["forest"](spark, SF_MID).collect():
        assert r["rmse"] < const_rmse


def test_importance_sums_to_one(spark):
    rows = QUERIES["importance_rank"](spark, SF_SMALL).collect()
    assert sum(r["share"] for r in rows) == pytest.approx(1.0, abs=1e-5)
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    assert sum(r["top5"] for r in rows) == 5


def test_cutpoint_search_not_worse_than_start(spark):
    rows = QUERIES["cutpoint_search"](spark, SF_SMALL).collect()
    grid = QUERIES["cutpoint_search_grid"](spark, SF_SMALL).collect()
    start_kappa = [r["kappa"] for r in grid if r["cand"] == 12][0]  # a=0, b=1: the start vector
    assert rows[0]["kappa"] >= start_kappa - 1e-6


def test_stream_equals_batch_fit(spark):
    """ST1: the streamed learner over one micro-batch equals one batch epoch."""
    from pyspark.sql import functions as F
    from ordlab.operators import ftrl
    from ordlab.plans.online import emb_labels, emb_long
    from ordlab.plans.catalog import T
    e = T(spark, SF_SMALL, "embeddings")
    prm = ftrl.FtrlParams(link="logistic", alpha=0.5, beta=1.0, l1=0.1, l2=0.1)
    st, _ = ftrl.fit(emb_long(e), emb_labels(e), prm, batch_size=100, epochs=1)
    want = {r["feature"]: round(r["w"], 6) for r in st.collect()}
    got = {r["feature"]: r["w"] for r in QUERIES["ftrl_stream"](spark, SF_SMALL).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_cut_refit_not_worse(spark):
    r = QUERIES["cut_refit_kappa"](spark, SF_SMALL).first()
    assert r["kappa_refit"] >= r["kappa_start"] - 1e-9


def test_stream_carries_state_across_micro_batches(spark, tmp_path):
    """ST1: three micro-batches (one file each, contiguous id ranges) give the
    same model as one batch pass over all rows in id order."""
    from pyspark.sql import functions as F
    from ordlab.operators import ftrl
    from ordlab.plans.catalog import T
    from ordlab.plans.online import emb_labels, emb_long
    from ordlab.streaming.ftrl_stream import run_stream
    e = T(spark, SF_SMALL, "embeddings").orderBy("vec_id").limit(60)  # the fixture: 60 rows
    ids = [r[0] for r in e.select("vec_id").collect()]
    src_dir = tmp_path / "src"
    for i in range(3):
        part = e.filter(F.col("vec_id").isin(ids[i * 20:(i + 1) * 20]))
        part.coalesce(1).write.parquet(str(src_dir / f"part{i}"))
    prm = ftrl.FtrlParams(link="logistic", alpha=0.5, beta=1.0, l1=0.1, l2=0.1)
    stream = (spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1)
              .parquet(str(src_dir / "part*")))
    stream = stream.withColumn("id", F.col("vec_id")).withColumn(
        "y", F.when(F.col("label") >= 5, 1.0).otherwise(0.0))
    st = run_stream(spark, stream, emb_long, prm, batch_size=10, root=str(tmp_path / "state"))
    got = {r["feature"]: r["w"] for r in st.collect()}
    full, _ = ftrl.fit(emb_long(e), emb_labels(e), prm, batch_size=10, epochs=1)
    want = {r["feature"]: r["w"] for r in full.collect()}
    assert got == pytest.approx(want, abs=1e-12)
    n_batches = spark.read.parquet(str(tmp_path / "state" / "state")).select("batch").distinct().count()
    assert n_batches == 3
