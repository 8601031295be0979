"""Operator 1 against sets of shingles computed in Python."""

import hashlib
import re

import pytest

from ordlab.llm import fingerprints as fp
from tests.llm.conftest import DOC, doc, prose


def shingles(text, k=5):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_neighbours_edits_and_likeness(spark, docs, rows):
    got = fp.neighbours(docs).collect()
    assert len(got) == len(rows)
    want = {}
    # order by falling id; among equal ids any order of different texts is accepted
    ids = sorted({r[0] for r in rows if r[0] is not None}, reverse=True) + [None]
    unique = {r[0]: r[1] or "" for r in rows}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, nxt = unique[a], unique[b]
        h = len(t) // 2
        want[a] = (t, nxt, t[:len(t) - h] + nxt[:h])
    repeated = {2, 12}
    for r in got:
        t, nxt, edited = want[r["doc_id"]]
        follows = ids[(ids.index(r["doc_id"]) + 1) % len(ids)]
        if r["doc_id"] in repeated or follows in repeated:
            continue
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(t, edited), abs=0.13)
        assert r["near_next"] == pytest.approx(jaccard(t, nxt), abs=0.13)
    by_text = {}
    for r in docs.select("doc_id", "text").collect():
        by_text.setdefault(r["text"] or "", set()).add(r["doc_id"])
    prints = {(r["doc_id"], r["fingerprint"]) for r in got}
    for same in by_text.values():
        assert set.intersection(*[{f for i, f in prints if i == x} for x in same])


def test_likeness_is_unbiased_over_overlaps(spark):
    pairs = [(k, prose(0, 300), prose(k, 300 + k)) for k in range(0, 300, 30)]
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    from pyspark.sql import functions as F
    got = df.select("k", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("x")).collect()
    err = [r["x"] - jaccard(prose(0, 300), prose(r["k"], 300 + r["k"])) for r in got]
    assert abs(sum(err) / len(err)) < 0.04 and max(map(abs, err)) < 0.12
    assert [r["x"] for r in got if r["k"] == 0] == [1.0]


def test_small_sets_do_not_agree_by_chance(spark):
    """One shingle fills all bins: different texts must still look different."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(f"alpha {i}", f"beta {i}") for i in range(60)], "a string, b string")
    got = [r[0] for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    assert max(got) < 0.1


def test_only_columns_no_python(spark, docs):
    plan = fp.neighbours(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_and_single(spark, empty):
    assert fp.neighbours(empty).collect() == []
    one = fp.neighbours(spark.createDataFrame([doc(1, "a b c d e f g")], DOC)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
