"""Operator 5: the network's gradient, held-out accuracy, defined results."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from ordlab.llm import kernels, quality
from tests.conftest import SF_MID
from tests.llm.conftest import DOC, doc


def one(text, model):
    """Probability by plain loops over bytes, blocks and chunks."""
    raw = text.encode()
    n = (len(raw) + quality.WIDTH + quality.BLOCK - 1) // quality.BLOCK
    x = list(raw) + [0] * (n * quality.BLOCK + quality.WIDTH - len(raw))
    blocks = []
    for b in range(n):
        at = [p for p in range(b * quality.BLOCK, (b + 1) * quality.BLOCK, quality.STRIDE) if p + quality.WIDTH <= n * quality.BLOCK]
        blocks.append(np.max([sum(model["table"][j][x[p + j]] for j in range(quality.WIDTH)) for p in at], axis=0))
    feats, b = [], 0
    while True:
        feats.append(np.maximum(np.max(blocks[b:b + quality.CHUNK], axis=0) + model["bias"], 0))
        if b + quality.CHUNK >= n:
            break
        b += quality.HOP
    h = np.concatenate([np.mean(feats, axis=0), np.max(feats, axis=0)])
    return 1 / (1 + np.exp(-(h @ model["w"] + model["w0"])))


def test_scores_match_plain_loops():
    rng = np.random.default_rng(1)
    model = {"table": rng.normal(0, .3, (quality.WIDTH, 256, quality.FILTERS)).astype("f4"), "bias": rng.normal(0, .1, quality.FILTERS).astype("f4"),
             "w": rng.normal(0, .5, 2 * quality.FILTERS).astype("f4"), "w0": np.float32(.2)}
    texts = ["", "a", "é" * 40, "plain words " * 30, "x" * 56, "y" * 57, "z" * 1000]
    got = np.concatenate([quality.probability(b, o, model) for _, b, o in kernels.slices(pa.array(texts), 300)])
    assert got == pytest.approx([one(t, model) for t in texts], abs=1e-5)


def test_held_out_accuracy_and_rows(spark):
    docs, labels = spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(got[i]["score"], y[i]) for i in y if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    good, bad = [s for s, v in held if v == 1], [s for s, v in held if v == 0]
    auc = np.mean([[(a > b) + .5 * (a == b) for b in bad] for a in good])
    assert auc > 0.95
    assert np.mean([(s >= .3) == v for s, v in held]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= .3) and 0 <= r["score"] <= 1 for r in got.values())


def test_only_the_training_fold_is_read(spark):
    """Flipped labels of the held-out fold must not change a score."""
    docs, labels = spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet")
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.labelled_sample(docs, labels), quality.labelled_sample(docs, flipped)
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_defined_results(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (5, 6)}) == 1
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).columns == DOC.names and quality.keep_good(docs, none).count() == len(rows)
    assert quality.score(empty, none).collect() == [] and quality.keep_good(empty, none).collect() == []
    assert quality.score(spark.createDataFrame([doc(1, "a")], DOC), none).count() == 1


def test_rows_under_one_id_are_drawn_one_by_one(spark):
    rows = [doc(7, f"text number {j}") for j in range(300)] + [doc(7, "same")] * 300
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    texts, y = quality.labelled_sample(df, labels)
    assert len(texts) == 301 and set(y) == {1.0}
    few, _ = quality.labelled_sample(df, labels, train_rows=60)
    assert 5 < len(few) < 90
