"""Operator 2: draws restated in Python; shares of the mixture."""

import hashlib
import math
import re
from collections import Counter

import pytest

from ordlab.llm import mixing
from tests.llm.conftest import DOC, doc


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_match_quantiles(spark, docs, rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1] or "")
    weight = {s: math.sqrt(n) for s, n in size.items()}
    rate = {s: sum(size.values()) * weight[s] / sum(weight.values()) / n if n else 0 for s, n in size.items()}
    want = Counter()
    for r in rows:
        u = int(hashlib.md5(f"{mixing.SEED}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2 ** 52
        n = poisson(rate[r[3]], u) if rate[r[3]] else 0
        for c in range(n):
            want[(r[0], r[1], c)] += 1
    out = mixing.mix(docs)
    got = Counter((r["doc_id"], r["text"], r["copy"]) for r in out.collect())
    assert got == want
    assert set(DOC.names) <= set(out.columns)
    assert mixing.mix(docs, keep=False).columns == DOC.names


def test_weights_reach_their_shares(spark):
    d = spark.createDataFrame([doc(i, "x" * 100, source="big" if i % 10 else "small") for i in range(4000)], DOC)
    got = Counter(r["source"] for r in mixing.mix(d, {"big": 1, "small": 1, "absent": 5}, budget=400_000).select("source").collect())
    total = sum(got.values())
    assert total == pytest.approx(4000, rel=0.06)  # a source without rows has no share
    assert got["big"] / total == pytest.approx(0.5, abs=0.04)
    assert not mixing.mix(d, {"small": 1}).filter("source = 'big'").count()


def test_same_draw_for_any_partitioning_and_no_python(spark, docs):
    a = sorted(map(str, mixing.mix(docs.repartition(7)).drop("rate").collect()))
    assert a == sorted(map(str, mixing.mix(docs.coalesce(1)).drop("rate").collect()))
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", mixing.mix(docs)._jdf.queryExecution().executedPlan().toString())


def test_empty(empty):
    assert mixing.mix(empty).collect() == []
