"""Operator 9: planted items with edits, the exact distance, defined results."""

import numpy as np

from ordlab.llm import decontaminate as dc
from tests.conftest import SF_MID
from tests.llm.conftest import DOC, doc, prose


def slow_distance(item, region):
    """Least edit distance to a stretch of the region, by the full table."""
    d = [[0] * (len(region) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        d[i][0] = i
        for j in range(1, len(region) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (item[i - 1] != region[j - 1]))
    return min(d[-1])


def test_distance_is_exact():
    r = np.random.default_rng(4)
    for _ in range(200):
        item, region = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(0, 20))
        d, a, b = dc.distance(item, region)
        assert d == slow_distance(list(item), list(region))
        assert 0 <= a <= b <= len(region) and d == slow_distance(list(item), list(region[a:b]))


def edit(words, n, r):
    w = list(words)
    for _ in range(n):
        i, kind = int(r.integers(len(w))), r.integers(3)
        if kind == 0:
            w[i] = f"zz{r.integers(10 ** 6)}"
        elif kind == 1:
            w.insert(i, f"zz{r.integers(10 ** 6)}")
        else:
            del w[i]
    return w


def test_recall_of_planted_passages(spark):
    """Items with up to the greatest number of edits, in foreign text; what is
    beyond it is left alone."""
    r = np.random.default_rng(9)
    items = [(i, " ".join(f"q{r.integers(400)}" for _ in range(int(r.integers(4, 60))))) for i in range(80)]
    rows, want, clean = [], set(), set()
    for i, t in items:
        w = t.split(" ")
        e = dc.edits(len(w))
        for n in {0, e}:
            k = len(rows)
            rows.append(doc(k, " ".join([*prose(k, k + 40).split(" "), *edit(w, n, r), *prose(k + 50, k + 60).split(" ")])))
            want.add((k, i))
        half = len(w) // 2
        if half > 6:
            clean.add(len(rows))
            rows.append(doc(len(rows), prose(3, 40) + " " + " ".join(w[:half]) + " " + prose(200, 220)))
    got = dc.find_leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got}
    assert len(want & found) / len(want) >= 0.98
    exact = {(x["doc_id"], x["item_id"]) for x in got if x["distance"] == 0}
    assert {p for p in want if items[p[1]][1] in rows[p[0]][1]} <= exact
    assert not {x["doc_id"] for x in got} & clean


def test_whole_table_finds_every_exact_passage(spark):
    docs, bench = spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/benchmark.parquet")
    texts = [(r["doc_id"], " ".join(r["text"].lower().split())) for r in docs.collect()]
    want = {(i, b["item_id"]) for b in bench.collect() for i, t in texts if " ".join(b["text"].lower().split()) in t}
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()}
    assert want and want <= got
    # whole words: an item whose last word runs on in the document is found at distance 1
    verbatim = {(d["doc_id"], b["item_id"]) for b in bench.collect() for d in docs.collect()
                if f" {' '.join(b['text'].split())} " in f" {' '.join(d['text'].split())} "}
    assert verbatim <= {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).filter("distance = 0").collect()}
    kept = {r["doc_id"] for r in dc.drop_leaks(docs, bench).select("doc_id").collect()}
    assert kept == {i for i, _ in texts} - {r["doc_id"] for r in dc.find_leaks(docs, bench).collect()}


def test_defined_results(spark, docs, rows, empty):
    items = [(1, None), (2, ""), (3, prose(10, 40)), (3, prose(10, 40).upper()), (None, prose(600, 640)), (5, "one two"), (6, " ")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, score string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()}
    assert got == {(i, 3) for i in (1, 2, 3, 10, 11)} | {(11, None), (8, 5), (9, 5)}
    kept = dc.drop_leaks(docs, bench)
    assert kept.columns == DOC.names and kept.count() == len([r for r in rows if r[0] not in (1, 2, 3, 8, 9, 10, 11)])
    assert dc.find_leaks(empty, bench).collect() == [] and dc.drop_leaks(empty, bench).collect() == []
    assert dc.find_leaks(docs, bench.limit(0)).collect() == [] and dc.drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_blocks_of_items_give_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, prose(20 * i, 20 * i + 25)) for i in range(7)], "item_id bigint, text string")
    whole = sorted(map(str, dc.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK", 2)
    assert sorted(map(str, dc.find_leaks(docs, bench).collect())) == whole and whole
