"""Operator 6 against all pairs of sets of words."""

import itertools
import random
import re

import pytest

from ordlab.llm import jaccard
from ordlab.llm.graph import components
from tests.conftest import SF_SMALL
from tests.llm.conftest import DOC, doc, prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k, num, den, kept=False):
    """rows: (id, text) -> sorted (id, set size, component id); a component's
    id is its least id that is not null.  With ``kept``: the id of each class
    and of each text without words."""
    sets = [shingles(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
            comp[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    if kept:
        return sorted([least.get(x) if sets[x] else rows[x][0] for x in range(len(rows)) if find(x) == x], key=str)
    return sorted([(i, len(sets[x]), least.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)], key=str)


def run(df, k, num, den):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(df, k, num, den).collect()], key=str)


def edited(words, r, share):
    return " ".join(w if r.random() > share else f"e{r.randint(0, 10 ** 6)}" for w in words)


def test_defined_cases(docs, rows):
    assert run(docs, 3, 90, 100) == brute([r[:2] for r in rows], 3, 90, 100)
    assert run(docs, 5, 80, 100) == brute([r[:2] for r in rows], 5, 80, 100)


def test_near_copies_in_many_groups(spark, monkeypatch):
    """Chains and large groups of near copies around the threshold, groups of a
    few nodes and blocks of few queries: no link is lost."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "QUERIES", 3)
    r, texts = random.Random(2), []
    for base in range(6):
        words = prose(100 * base, 100 * base + 90).split(" ")
        texts += [edited(words, r, 0.012 * (j % 4)) for j in range(22)]
        for _ in range(12):  # a chain: each a little further on
            words = words[2:] + [f"n{r.randint(0, 10 ** 6)}", "and"]
            texts.append(" ".join(words))
    texts += [" ".join(["a common line of words"] + prose(i, i + 6).split(" ")) for i in range(60)]
    r.shuffle(texts)
    rows = [doc(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for k, num in ((3, 90), (5, 80)):
        want = brute([x[:2] for x in rows], k, num, 100)
        assert len({c for _, _, c in want}) < len(rows) - 40
        assert run(df, k, num, 100) == want


def test_smallest_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert run(df, 3, 90, 100) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], 3, 90, 100)


def test_one_of_each_class_stays(docs, rows, empty):
    kept = jaccard.one_per_class(docs, 5, 80, 100)
    assert kept.columns == DOC.names
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == brute([r[:2] for r in rows], 5, 80, 100, kept=True)
    assert jaccard.one_per_class(empty).collect() == [] and jaccard.classes(empty).collect() == []


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(200, 200), (205, 203), (203, 201)]
    random.Random(0).shuffle(links)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(31)} | {205: 201, 203: 201, 201: 201}
    assert got == want


@pytest.mark.parametrize("sizes", [(1, 1), (3, 5), (40, 200)])
def test_overlaps_are_exact(sizes):
    import numpy as np
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, n).astype(np.uint64)) for n in sizes for _ in range(3)]
    got = jaccard.overlaps(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_words_of_thue_morse_order_differ():
    """A polynomial hash modulo 2**64 takes such a word for its complement."""
    import numpy as np
    from ordlab.llm import kernels
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    buf = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    h, _ = kernels.word_hashes(buf, np.array([0, len(buf)]))
    assert h[0] != h[1] and h[0] == h[2]
    one = kernels.byte_hash(np.frombuffer(b"zzabc", np.uint8), np.array([2]), np.array([5]))
    assert one[0] == kernels.byte_hash(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))[0]


def test_columns_of_any_name_come_through(spark):
    names = ["_id", "_tx", "_c", "_n", "_gd", "__id", "__tx", "__c"]
    text = prose(0, 60)
    rows = [(i, t, *[f"{c}-{i}" for c in names]) for i, t in [(2, text), (1, text), (3, "other words"), (3, "other words")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = jaccard.one_per_class(df, 5, 80, 100)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[1], rows[2]]


def test_of_equal_rows_the_same_one_stays(spark):
    text = prose(0, 60)
    rows = [(1, text, f"v{j}", {"k": j}) for j in range(6)]
    schema = "doc_id long, text string, v string, m map<string,int>"
    got = {jaccard.one_per_class(spark.createDataFrame(rows[::s], schema).repartition(p), 5, 80, 100).collect()[0]["v"] for s, p in ((1, 1), (-1, 3), (1, 4))}
    assert len(got) == 1


def test_texts_with_a_passage_in_common_are_seldom_fetched(spark, monkeypatch):
    """The passages hold the least value of one hash in about a third of the
    texts, of both in about a ninth; texts are sent compressed."""
    r = random.Random(5)
    passages = [" ".join(f"p{j}x{i}" for i in range(60)) for j in range(20)]
    rows = [(i, passages[i % 20] + " " + " ".join(f"w{i}x{r.randint(0, 10 ** 9)}" for _ in range(120))) for i in range(200)]
    sent, plain = [], jaccard.compare

    def compare(found, *rest):
        sent.append((found.count(), dict(found.dtypes)["text"]))
        return plain(found, *rest)

    monkeypatch.setattr(jaccard, "compare", compare)
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100) == brute(rows, 3, 90, 100)
    assert sent[0][0] < 45 and {t for _, t in sent} == {"binary"}
