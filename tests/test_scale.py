"""What grows with the input: tasks of a fit, jobs of a learner, tables of a search."""

from ordlab.session import dealt
from tests.conftest import SF_SMALL

SF = "/root/testdata/sf0.1"


def test_rows_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(200_000).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert one.rdd.getNumPartitions() == 1
    d = dealt(one, "id")
    sizes = d.rdd.glom().map(len).collect()
    assert len(sizes) == 4 and sum(sizes) == 200_000 and max(sizes) < 60_000
    assert len(dealt(one, "id", 10_000).rdd.glom().collect()) == 20
    assert dealt(one.limit(3), "id").collect() and dealt(one.filter("id < 0"), "id").collect() == []


def test_boosting_rows_come_in_several_tasks(spark):
    from ordlab.plans.boosting import explained
    assert explained(spark, SF).rdd.getNumPartitions() > 1


def _sparse(spark, n=97, batch=10):
    import numpy as np
    r = np.random.default_rng(3)
    rows = [(i, f"f{j}", float(r.normal())) for i in range(n) for j in r.choice(12, 5, replace=False)]
    rows += [(5, "f1", 0.5), (7, None, 1.0), (8, "f2", None), (200, "f3", 1.0), (21, "new", 2.0)]
    y = [(i, float(r.random() < 0.5) if i != 11 else None) for i in range(n)] + [(300, 1.0)]
    return spark.createDataFrame(rows, "id long, feature string, value double"), spark.createDataFrame(y, "id long, y double")


def _jobs(spark, tag, call):
    sc = spark.sparkContext
    sc.setJobGroup(tag, tag)
    out = call()
    n = len(sc.statusTracker().getJobIdsForGroup(tag))
    sc._jsc.clearJobGroup()
    return out, n


def test_ftrl_runs_take_the_steps_of_single_batches(spark, monkeypatch):
    import pytest
    from pyspark.sql import functions as F
    from ordlab.operators import ftrl
    long, labels = _sparse(spark)
    for link in ("logistic", "identity"):
        prm = ftrl.FtrlParams(alpha=0.1, l1=0.05, l2=0.1, link=link, dropout=0.2)
        start = ftrl.zero_state(long).filter("feature is null or feature <> 'new'").withColumn("z", F.lit(0.3))
        got = []
        for values in (0, 90, 1 << 20):  # single batches, short runs, one run
            monkeypatch.setattr(ftrl, "RUN_VALUES", values)
            st, _ = ftrl.fit(long, labels, prm, batch_size=10, epochs=2, state=start)
            got.append({r["feature"]: pytest.approx((r["z"], r["n"], r["w"]), abs=1e-12) for r in st.collect()})
        once = {r["feature"]: (r["z"], r["n"], r["w"]) for r in st.collect()}
        assert set(once) == {None, *(f"f{j}" for j in range(12))} and any(x[2] for x in once.values())
        assert got[0] == once and got[1] == once and got[2] == once


def test_ftrl_jobs_do_not_grow_with_the_batches(spark):
    from ordlab.operators import ftrl
    long, labels = _sparse(spark)
    prm = ftrl.FtrlParams(l1=0.05)
    few, many = (_jobs(spark, f"ftrl{b}", lambda b=b: ftrl.fit(long, labels, prm, batch_size=b)[0].collect())[1] for b in (50, 1))
    assert 0 < many <= few + 3


def test_stream_jobs_do_not_grow_with_the_batches(spark, tmp_path):
    from pyspark.sql import functions as F
    from ordlab.operators import ftrl
    from ordlab.streaming.ftrl_stream import batch_step
    rows = spark.createDataFrame([(i, float(i % 3 == 0), [1.0, i / 40]) for i in range(60)], "id int, y double, x array<double>")

    def to_long(df):
        return df.select("id", F.posexplode("x").alias("f", "value")).select("id", F.concat(F.lit("f"), F.col("f")).alias("feature"), "value")

    def jobs(size):
        step = batch_step(spark, to_long, ftrl.FtrlParams(), size, str(tmp_path / str(size)))
        return _jobs(spark, f"stream{size}", lambda: step(rows, 0))[1]

    assert 0 < jobs(2) <= jobs(30) + 3


def test_small_micro_batch_is_a_few_jobs_with_the_same_steps(spark, tmp_path, monkeypatch):
    """a micro-batch (a source file) took some thirty jobs however small it was."""
    import pytest
    from pyspark.sql import functions as F
    from ordlab.operators import ftrl
    from ordlab.streaming.ftrl_stream import _latest_state, batch_step
    long, labels = _sparse(spark)
    long = long.unionByName(spark.createDataFrame([(None, "f4", 9.0), (400, None, 1.0)], long.schema))
    labels = labels.unionByName(spark.createDataFrame([(None, 1.0), (None, 0.0)], labels.schema))
    prm = ftrl.FtrlParams(alpha=0.1, l1=0.05, l2=0.1, dropout=0.2)
    got = []
    for values in (1 << 20, 90):
        monkeypatch.setattr(ftrl, "RUN_VALUES", values)
        root = str(tmp_path / str(values))
        step = batch_step(spark, lambda df: long.join(df.select("id"), "id"), prm, 10, root)
        for n, some in ((0, "id < 40 or id is null"), (1, "id >= 40"), (3, "id > 10"), (1, "id >= 40")):
            step(labels.filter(some), n)
        assert _latest_state(spark, root, before=0) is None
        for before in (1, 2, 3, None):
            st = _latest_state(spark, root, before).collect()
            got.append((values, before, {r["feature"]: (r["z"], r["n"], r["w"]) for r in st}))
            assert len(st) == len(got[-1][2])  # a null feature has one row, too
    for a, b in zip(got[:4], got[4:]):
        assert set(a[2]) == set(b[2]) and all(x == pytest.approx(b[2][k], abs=1e-12) for k, x in a[2].items())
    assert any(x[2] for x in got[3][2].values())
    monkeypatch.undo()
    rows = spark.createDataFrame([(i, float(i % 3 == 0)) for i in range(60)], "id int, y double")
    step = batch_step(spark, lambda df: df.select("id", F.lit("f").alias("feature"), F.col("y").alias("value")), prm, 10, str(tmp_path / "jobs"))
    assert 0 < max(_jobs(spark, f"micro{n}", lambda n=n: step(rows, n))[1] for n in range(2)) <= 10


def _emb(spark, n=700):
    import numpy as np
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 10))
    x[:, 3] = x[:, 1] ** 2 + 0.2 * x[:, 3]
    x[:, 9] = np.round(x[:, 9])  # ties go by id
    names = [f"c{j}" for j in range(10)]
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{k} double" for k in names)), names, x


def test_pair_counts_make_no_row_per_pair(spark, monkeypatch):
    """all maximal grids against numpy, with several tasks per pair of blocks; the only
    explode is that over features."""
    import numpy as np
    from ordlab.operators import select as sel
    df, names, x = _emb(spark)
    monkeypatch.setattr(sel, "BLOCK_ROWS", 200)
    levels = [(1, 4), (3, 2)]
    joint = sel.joint_counts(df, "id", names, 700, 4, levels)
    plan = joint._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") <= 1
    got = {}
    for r in joint.collect():
        got[r.fa, r.fb] = got.get((r.fa, r.fb), 0) + np.frombuffer(r.counts, "<i4")
    bins = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0) * 16 // 700
    assert len(got) == 45
    for (a, b), counts in got.items():
        want = [np.bincount((bins[:, a] >> (4 - u) << v) + (bins[:, b] >> (4 - v)), minlength=1 << (u + v)) for u, v in levels]
        assert (counts == np.concatenate(want)).all()


def test_mrmr_pairs_shuffle_no_cells(spark):
    """what a pair shuffles is its counts on the largest grids, a row per pair and task."""
    from ordlab.operators import select as sel
    df, names, _ = _emb(spark)
    joint = sel.joint_counts(df, "id", names, 700, 4, [(x, 5 - x) for x in range(1, 5)])
    rows = joint.collect()
    assert len(rows) == 45 and all(len(r.counts) == 4 * 4 * 32 for r in rows)
    picks = sel.mrmr(sel.pair_mic(df, "id", names), "c3")
    assert picks[0][:2] == (1, "c1")


def test_mrmr_bins_write_no_values(spark, monkeypatch):
    """after the sort only ids and places are written; up to 256 bins a row sends a byte
    per feature and block, and a block with itself is sent once."""
    from pyspark.sql.classic.dataframe import DataFrame
    from ordlab.operators import rank
    from ordlab.operators import select as sel
    df, names, _ = _emb(spark)
    written, plain = [], rank.materialize
    monkeypatch.setattr(rank, "materialize", lambda d, *a: written.append(d.columns) or plain(d, *a))
    joint = sel.joint_counts(df, "id", names, 700, 4, [(2, 3)])
    assert sorted(written[0]) == ["__local", "__pid", "fi", "id"]
    assert len(joint.collect()) == 45
    batches = []
    monkeypatch.setattr(sel, "BLOCK", 5)
    real = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema: batches.append(real(self, f, schema)) or batches[-1])
    sel.joint_counts(df, "id", names, 700, 4, [(2, 3)])
    size = {}
    for r in batches[-1].collect():
        size[r.a, r.b] = size.get((r.a, r.b), 0) + len(r.xa) + len(r.xb)
    assert size == {(0, 0): 3500, (0, 1): 7000, (1, 1): 3500}


def test_search_runs_in_several_tasks(spark):
    """small counts are not put together in one task; the rows of a search share logarithms."""
    import numpy as np
    from ordlab.operators import select as sel
    df, names, _ = _emb(spark)
    found = sel.pair_mic_search(df, "id", names)
    assert found.rdd.getNumPartitions() >= 8 and found.count() == 45
    r = np.random.default_rng(6)
    for bins in (20, 33):  # gains of every number of rows against the plain sum
        table = r.integers(0, 4, (bins, bins))
        cum = np.vstack([np.zeros(bins), table.cumsum(0)])
        for rows, q, gain in sel._merged_gains(table, bins):
            cut = np.arange(bins) * rows // bins
            y = np.stack([cum[:, cut == k].sum(1) for k in range(rows)], 1)
            assert (q == y[-1]).all()
            for a, b in ((0, bins), (2, 9), (7, 8)):
                part = y[b] - y[a]
                part = part[part > 0]
                assert abs(gain[a, b] - (part * np.log(part / part.sum())).sum()) < 1e-9


def test_searches_share_bins_and_logarithms(spark, monkeypatch):
    """the query sorted all values twice, and every group of numbers of rows took the
    logarithms of its intervals anew."""
    import numpy as np
    from ordlab.operators import select as sel
    from ordlab.plans import selection
    df, names, _ = _emb(spark)
    bins = sel.Bins(df, "id", names[:4])
    plain, shared = ({(r.feature_a, r.feature_b): r.mic for r in f(df, "id", names[:4], **k).collect()}
                     for f, k in ((sel.pair_mic_search, {}), (sel.pair_mic_search, {"bins": bins})))
    assert len(plain) == 6 and plain == shared
    assert sorted(sel.pair_mic(df, "id", names[:4]).collect()) == sorted(sel.pair_mic(df, "id", names[:4], bins=bins).collect())
    sorts, plain_bins = [], sel.feature_bins
    monkeypatch.setattr(sel, "feature_bins", lambda *a: sorts.append(a) or plain_bins(*a))
    selection.q_pair_mic_search(spark, "/root/testdata/sf0.001")
    assert len(sorts) == 1
    table, taken = np.random.default_rng(7).integers(0, 4, (40, 64)), []
    f = sel._x_log_x(int(table.sum()))
    monkeypatch.setattr(sel, "_x_log_x", lambda n: lambda x: taken.append(x.size) or f(x))
    assert len(list(sel._merged_gains(table, 64))) == 63
    spans = {(k * 64 // r, (k + 1) * 64 // r) for r in range(2, 65) for k in range(r)}
    assert sum(taken) <= (len(spans) + 64) * 820


def test_learner_rows_come_in_several_tasks(spark):
    """The train part of the wide table, and what a fit keeps of it."""
    from ordlab.operators import models as md
    from ordlab.plans.learners import FEATS, _split
    tr, te = _split(spark, SF)
    assert tr.rdd.getNumPartitions() > 1 and te.rdd.getNumPartitions() > 1
    one = tr.coalesce(1)
    seen = []

    class Seen(Exception):
        pass

    def expand(df, *args):
        seen.append(df.rdd.getNumPartitions())
        raise Seen

    old, md.ebc_expand = md.ebc_expand, expand
    try:
        md.ebc_fit(one, FEATS, "y")
    except Seen:
        pass
    finally:
        md.ebc_expand = old
    assert seen[0] > 1


def test_grouped_kappa_joins_in_bounded_tasks(spark, monkeypatch):
    """both sides of the join are dealt by a number of rows."""
    from ordlab.plans import decoding
    seen = []

    def spy(df, key, rows):
        out = dealt(df, key, rows)
        seen.append((key, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(decoding, "dealt", spy, raising=False)
    assert decoding.q_grouped_weighted_kappa(spark, SF).count() == 1
    assert seen == [("id", 4), ("id", 4)]


def test_greedy_rounds_read_pinned_predictions(spark, monkeypatch):
    """no round hashes the orders into runs again."""
    from ordlab.plans import ensembles
    seen = []
    monkeypatch.setattr(ensembles.en, "greedy_selection", lambda preds, cdf, **kw: seen.extend([preds, cdf]) or [])
    assert ensembles.q_ensemble_greedy(spark, "/root/testdata/sf0.001").collect() == []
    assert all("md5" not in x._jdf.queryExecution().executedPlan().toString() for x in seen)


def test_bagged_rounds_read_pinned_rows(spark, monkeypatch):
    """what a round decodes comes from one pinned table, without a join or an aggregate of rows."""
    from ordlab.operators import bagging as bg
    plans = []
    plain = bg.decode_cdf

    def spy(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *args, **kw)

    monkeypatch.setattr(bg, "decode_cdf", spy)
    rows = [(m, 1, i, float(i % k + 1), i % 8 + 1) for i in range(64) for m, k in (("a", 8), ("b", 5), ("c", 3))]
    rows = [r for r in rows if r[:3] != ("b", 1, 7)] + [("b", 1, 70, None, 3)]  # a missing and a null prediction
    df = spark.createDataFrame(rows, "model string, run int, id long, prediction double, target int")
    cdf = spark.createDataFrame([(1, k, k / 8) for k in range(1, 9)], "run int, cls int, cdf double")
    sel = bg.bagged_selection(df, cdf, bags=2, init_top_k=1)
    assert len(plans) >= 2 and not [p for p in plans if "Join" in p or "Aggregate" in p or "Exchange" in p]
    assert len(sel.chosen) == 2 and sel.blends.filter("blend is null and id <> 70").isEmpty()


def test_decode_keeps_the_boundaries_in_one_array(spark):
    """as columns beside every row they made a generated method too long to be compiled."""
    from ordlab.operators.decode import decode_cdf
    df = spark.range(100).selectExpr("id", "cast(id as double) s")
    cdf = spark.createDataFrame([(k, k / 8) for k in range(1, 9)], "cls int, cdf double")
    out = decode_cdf(df, "s", "id", cdf)
    assert "__v13" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.cls: r["count"] for r in out.groupBy("cls").count().collect()}[1] == 11


def test_bagged_stack_scores_its_rows_once(spark, monkeypatch):
    """F8: rows of the upper layer are kept for the two passes of the linear fit and let go after it;
    bags add a column to the test rows, without a join."""
    from ordlab.plans import learners
    seen, plain, tables = [], learners.md.linear_booster, []
    monkeypatch.setattr(learners.md, "linear_booster", lambda df, *a: seen.append((df, df.is_cached)) or plain(df, *a))
    write = learners.materialize
    monkeypatch.setattr(learners, "materialize", lambda df, tag: tables.append((tag, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, tag))
    out = learners.q_bagged_stack(spark, SF_SMALL)
    assert [kept for _, kept in seen] == [True] * 3 and not any(df.storageLevel.useMemory for df, _ in seen)
    assert tables[-1][0] == "votes" and "Join" not in tables[-1][1]
    assert out.count() > 0 and not out.filter("vote is null or vote not between 1 and 8").count()
