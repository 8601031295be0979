"""Order statistics by refined histograms against sorting in numpy."""

import struct

import numpy as np
import pytest

from pyspark.sql import functions as F

from ordlab.functions.scalar import order_value, with_order_code
from ordlab.operators import orderstats as osx
from ordlab.operators.clean import fill_median
from ordlab.operators.decode import decode_cdf


def test_order_code_is_the_bits_of_a_double(spark):
    rng = np.random.default_rng(0)
    v = [2.0 ** e for e in range(-1074, 1024, 3)] + [np.nextafter(2.0 ** e, s) for e in range(-1021, 1024, 5) for s in (0, np.inf)]
    v += np.frombuffer(rng.bytes(8000), "<f8").tolist() + [0.0, -0.0, float("inf"), 5e-324]
    v = [float(x) for x in v if x == x]
    v += [-x for x in v]
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "x double")
    for r in with_order_code(df, "x", "k").withColumn("back", order_value("k")).collect():
        if r.x is None:
            assert (r.k, r.back) == (-(1 << 63), None)
        elif r.x != r.x:
            assert r.k == (1 << 63) - 1 and r.back != r.back
        else:
            bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
            assert (r.k, r.back) == (-bits if r.x < 0 else bits, r.x)


def scores():
    """Groups whose scores are continuous, tied, constant, tiny, of many scales, null and NaN."""
    rng = np.random.default_rng(4)
    g = {"even": rng.uniform(0, 9, 900), "ties": rng.integers(0, 3, 800).astype(float), "one": np.full(700, 2.5),
         "scales": 10.0 ** rng.uniform(-300, 300, 600) * rng.choice([-1, 1], 600), "few": np.array([3.0, -1.0]), "single": np.array([7.0])}
    rows, i = [], 0
    for name, v in g.items():
        for x in v:
            rows.append((name, i * 7919 % 100_003 - 50_000, float(x)))
            i += 1
    rows += [("gaps", 900_000 + j, None if j % 3 else float("nan") if j % 2 else j / 7) for j in range(300)]
    rows += [(None, 1_000_000 + j, j / 3.0) for j in range(50)]
    return rows


@pytest.mark.parametrize("digits,small", [(1 << 12, 4096), (16, 3), (2, 1)])
def test_ranks_equal_the_sort(spark, monkeypatch, digits, small):
    monkeypatch.setattr(osx, "DIGITS", digits)
    monkeypatch.setattr(osx, "SMALL", small)
    rows = scores() if digits > 2 else [r for r in scores() if r[0] in ("ties", "few", "gaps", None)]
    df = spark.createDataFrame(rows, "g string, id long, s double").repartition(5)
    keyed = osx.keyed(df, "s", "id")
    shares = [0.0, 0.1, 0.25, 0.5, 0.8, 0.999, 1.0, 2.0]
    ends = lambda x: x.withColumn("__ends", F.array(*[F.floor(F.col("n") * f) for f in shares]))
    sizes, at = osx.rank_keys(keyed.select("g", "__v", "__i"), ["g"], ends)
    got = {(r.g, r["rank"]): (r.v, r.i) for r in at.select("g", "rank", order_value("v").alias("v"), "i").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        s = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] != r[2], r[2] if r[2] is not None and r[2] == r[2] else 0.0, r[1]))
        want |= {(g, int(len(s) * f)): (s[int(len(s) * f)][2], s[int(len(s) * f)][1]) for f in shares if int(len(s) * f) < len(s)}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    assert {r.g: r.n for r in sizes.collect()} == {g: sum(r[0] == g for r in rows) for g in {r[0] for r in rows}}


def test_decode_of_many_groups_writes_no_rows(spark, monkeypatch):
    """The decode equals the ranks of a sort, and only tables of a row per group and rank are written."""
    from ordlab import session
    written = []
    real = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, tag="stage", **kw: written.append(real(df, tag, **kw)) or written[-1])
    monkeypatch.setattr(osx, "SMALL", 16)
    monkeypatch.setattr(osx, "DIGITS", 64)
    rng = np.random.default_rng(8)
    data = [(g, i, float(np.round(rng.normal(), 1 + g % 3))) for g in range(5) for i in range(1000 + g)]
    cdf = [(k + 1, float(f)) for k, f in enumerate([0.1, 0.1, 0.35, 0.5, 0.501, 0.8, 0.95, 1.0])]
    df = spark.createDataFrame(data, "g int, id long, s double")
    out = decode_cdf(df, "s", "id", spark.createDataFrame(cdf, "cls int, cdf double"), by=["g"], cdf_by=[]).collect()
    assert all(w.count() <= 5 * 14 for w in written) and written
    got = {(r.g, r.id): r.cls for r in out}
    f = [x[1] for x in cdf]
    for g in range(5):
        rows = sorted((r for r in data if r[0] == g), key=lambda r: (r[2], r[1]))
        n = len(rows)
        cls = [8] * n
        for k in range(6, -1, -1):
            lo, hi = (int(n * f[k - 1]) if k else 0), int(max(n * f[k] - 1, 0))
            cls[lo:hi] = [k + 1] * max(hi - lo, 0)
        assert [got[(g, r[1])] for r in rows] == cls


def test_median_fill_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(osx, "SMALL", 8)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=401), rng.integers(0, 5, 401).astype(float)
    rows = [(i % 2, None if i % 5 == 0 else float(a[i]), None if i % 7 == 0 else float(b[i]), None) for i in range(401)]
    df = spark.createDataFrame(rows, "split int, a double, b double, empty double")
    out = fill_median(df, ["a", "b", "empty"], by=["split"], suffix="_f").collect()
    for s in (0, 1):
        ma = np.median([r[1] for r in rows if r[0] == s and r[1] is not None])
        mb = np.median([r[2] for r in rows if r[0] == s and r[2] is not None])
        got = [r for r in out if r.split == s]
        assert {r.a_f for r in got if r.a is None} == {ma} and {r.b_f for r in got if r.b is None} == {mb}
        assert all(r.empty_f is None for r in got)
    whole = fill_median(df, ["a"], suffix="_f").filter("a is null").select("a_f").distinct().collect()
    assert [r.a_f for r in whole] == [np.median([r[1] for r in rows if r[1] is not None])]
