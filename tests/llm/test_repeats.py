"""Operator 7 against every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np

from ordlab.llm import repeats
from tests.conftest import SF_SMALL
from tests.llm.conftest import DOC, doc, prose


def brute(rows, length):
    """rows: (id, text); the same columns as the operator, as a multiset."""
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, t in raw:
        for k in range(len(t) - length + 1):
            seen[t[k:k + length]] += 1
    out = Counter()
    for i, t in raw:
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                cover[k:k + length] = True
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        spans = int((cover & ~np.concatenate(([False], cover[:-1]))).sum()) if len(t) else 0
        out[(i, len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)] += 1
    return out


def run(df, length, gram, local=repeats.LOCAL):
    return Counter((*r[:5], bytes(r["kept"])) for r in repeats.remove_repeats(df, length, gram, local, with_kept=True).collect())


def test_defined_cases(docs, rows):
    assert run(docs, 200, 64) == brute([r[:2] for r in rows], 200)


def test_all_documents_of_the_smallest_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert run(df, 200, 64) == brute([(r["doc_id"], r["text"]) for r in df.collect()], 200)


def test_shared_passages_in_small_and_large_buckets(spark):
    """Passages cut at random places, periodic texts, one line in most texts;
    the two ways to finish a bucket agree."""
    r = random.Random(3)
    line = prose(0, 14)
    rows = [doc(i, " ".join([prose(20 * i % 700, 20 * i % 700 + r.randint(3, 30)), line[r.randint(0, 9):], prose(100, 100 + r.randint(5, 40))[r.randint(0, 20):]]))
            for i in range(40)] + [doc(90, "ab" * 150), doc(91, "ab" * 33), doc(92, "abc" * 90 + line), doc(93, line * 3)]
    df, want = spark.createDataFrame(rows, DOC), brute([x[:2] for x in rows], 40)
    assert run(df, 40, 12) == want
    assert run(df, 40, 12, local=0) == want  # every bucket by the distributed pass
    assert run(df, 40, 12, local=5) == want


def test_empty(empty):
    assert repeats.remove_repeats(empty).collect() == []
