"""Operator 8: held-out accuracy, calibration, defined results."""

import zlib

import numpy as np
import pyarrow as pa

from ordlab.llm import kernels, langid
from tests.conftest import SF_MID
from tests.llm.conftest import DOC, doc


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(true)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    right = np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held])
    assert right > 0.97
    assert abs(np.mean([r["score"] for r in held]) - right) < 0.05  # calibrated
    assert np.mean([r["accepted"] for r in held]) > 0.9


def test_training_ignores_the_held_out_fold(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(langid.fold(F.col("doc_id"), 4) == 2, F.lit("zz")).otherwise(F.col("lang")))
    assert langid.labelled_sample(docs) == langid.labelled_sample(wrong)


def test_logits_do_not_depend_on_slices():
    model = langid.train([b"aa bb cc", b"xx yy zz"] * 10, ["p", "q"] * 10)
    texts = ["aa bb", "", "zz yy é", "cc" * 300]
    a = np.concatenate([langid.logits(b, o, model) for _, b, o in kernels.slices(pa.array(texts), 1 << 20)])
    b = np.concatenate([langid.logits(b, o, model) for _, b, o in kernels.slices(pa.array(texts), 1)])
    assert np.allclose(a, b)


def test_defined_results(spark, docs, rows, empty):
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (5, 6, 7, 13):  # null, empty, blank, no letter
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] in ("en", "de", "fr") and 0 <= r["score"] <= 1
    assert langid.predict(empty, langid.fit(empty)).collect() == []
    only = spark.createDataFrame([doc(1, "abc", None), doc(2, "日本", None)], DOC)
    assert {r["lang_pred"] for r in langid.predict(only, langid.fit(only)).collect()} == {"und"}
    assert langid.has_letter(*kernels.text_arrays(pa.array(["日本", "1 2", "é"]))).tolist() == [True, False, True]


def test_any_number_of_languages(spark):
    """More than 200 languages, repeated ids and rows, and no text under a language."""
    rows = [doc(3 * k + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 5, f"l{k}") for k in range(201) for j in range(3)]
    rows += [doc(1, f"text {j}", "l0") for j in range(40)] + [doc(2, "same", "l1")] * 40 + [doc(9000, None, "nothing")]
    df = spark.createDataFrame(rows, DOC)
    texts, langs = langid.labelled_sample(df)
    assert len(set(langs)) == 201 and "nothing" not in langs
    assert texts.count(b"same") <= 1
    few, _ = langid.labelled_sample(df, rows_per_lang=2)
    assert len(few) < 0.9 * len(texts)
    model = langid.train(texts, langs, epochs=1)
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} <= {*langs, "und"}
