"""Operator 12 against a brute-force search of every lag of every text."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import types as T

from ordlab.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs by the definition: every lag, every maximal stretch, the smallest lag of equal stretches."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and (s, e) not in seen:
                seen.add((s, e))
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = (None,) * 4
    if runs:
        s, n, q = next(r for r in runs if all(r[1] * o[2] >= o[1] * r[2] for o in runs))
        best = (s, n, q, 1000 * n // q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts():
    rng = random.Random(3)
    out = []
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(1, 90):
            if rng.random() < 0.5:
                words += rng.choices("abc", k=rng.randrange(1, 6))
            else:
                unit = rng.choices("abcdef", k=rng.randrange(1, 7))
                words += (unit * rng.randrange(2, 9))[:rng.randrange(1, 50)]
        out.append(words)
    return out


def test_runs_equal_the_definition():
    cases = texts() + [["a"] * 300, ["a", "b"] * 100, (["a"] * 9 + ["b"]) * 20, list("abaab" * 30), [], ["x"] * 5, ["x"] * 6, list("abcabcabca"), list("abcabcabcabc")]
    x, y = "a", "ab"
    for _ in range(12):  # Fibonacci words are dense in repetitions
        x, y = y, y + x
    cases += [list(y), [str(w) for w in np.random.default_rng(0).integers(0, 2, 3000)]]
    word, doc = [], []
    for k, c in enumerate(cases):
        word += c
        doc += [k] * len(c)
    code = np.unique(word, return_inverse=True)[1].astype(np.int64)
    first = np.searchsorted(doc, np.arange(len(cases)))
    got = [[] for _ in cases]
    for s, n, q in periodic.runs_of(code, np.array(doc)):
        got[doc[s]].append((int(s - first[doc[s]]), n, q))
    for g, c in zip(got, cases):
        assert g == brute(c), c


def test_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()),
                           T.StructField("best", T.StringType())])
    rows = [(i, " ".join(w), "x", None) for i, w in enumerate(texts())]
    rows += [(1000 + i, " ".join(f"w{j}" for j in range(i)), None, None) for i in range(120)]  # a tenth get a planted run
    rows += [(5000, None, "x", "y"), (5001, "", "x", "y"), (5002, " \t\n ", "", ""), (None, "a " * 7, "", ""), (7, "é\n日本\té 日本 é 日本 é 日本 x", "", ""),
             (7, "é\n日本\té 日本 é 日本 é 日本 x", "", ""), (8, "a\x85b " * 9 + "end", "", ""), (9, "<|x|> " * 6, "", "")]
    got = periodic.summary(spark.createDataFrame(rows, schema).repartition(3)).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in (r[0] if r[0] is not None else -1, r[1], r[7]))
    assert sorted(map(tuple, got), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert periodic.summary(spark.createDataFrame([], schema)).collect() == []


def test_a_text_longer_than_a_slice(spark):
    unit = " ".join(f"word{i}" for i in range(1000))
    text = "start " + f"{unit} " * 700 + "end " + "same " * 300_000  # about 7 MB
    row = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [tuple(r) for r in row.runs] == [(1, 700_000, 1000), (700_002, 300_000, 1)]
    assert row.collapsed == f"start {unit} end same"
