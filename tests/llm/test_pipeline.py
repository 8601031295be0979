"""The pipeline's stages on the smallest table, held against plain Python."""

from collections import Counter

import corpus_pipeline
from ordlab.llm import mixing, quality
from tests.conftest import SF_SMALL
from tests.llm.test_jaccard import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "n-gram", "benchmark", "mixing", "token-ID"]
    keep = stages["quality classifier"](spark, docs, SF_SMALL)
    assert keep.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in keep.collect()} == want and 0 < len(want) <= 200
    keep = spark.createDataFrame(keep.collect(), docs.schema)
    single = stages["n-gram Jaccard join"](spark, keep, SF_SMALL)
    assert {r["doc_id"] for r in single.collect()} == {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in keep.collect()], 5, 80, 100)}
    single = spark.createDataFrame(single.collect(), docs.schema)
    clean = stages["benchmark decontamination"](spark, single, SF_SMALL)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in single.collect() if any(i in " ".join(r["text"].lower().split()) for i in items)}
    gone = {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()}
    assert held <= gone and len(gone) <= len(held) + 3
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    mixed = stages["mixing sources to target weights"](spark, clean, SF_SMALL)
    assert mixed.columns == docs.columns
    n = Counter(r["doc_id"] for r in mixed.collect())
    assert n == Counter(r["doc_id"] for r in mixing.mix(clean).collect())
    mixed = spark.createDataFrame(mixed.collect(), docs.schema)
    out = stages["token-ID / binary output"](spark, mixed, SF_SMALL).collect()
    assert Counter(r["doc_id"] for r in out) == n
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_stages_on_null_and_empty_documents(spark, docs, empty):
    for source in (docs, empty):
        cur = source.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, cur, SF_SMALL)
            rows = got.collect()
            cur = spark.createDataFrame(rows, got.schema)
    assert cur.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
