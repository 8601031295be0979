"""Corpus pipeline: documents -> token-id files, in five stages.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``.

Nulls: a null text counts as empty; it has no words, so it is no near duplicate
and leaks nothing, and it encodes to the end id alone.  Repeated rows are one
class of near duplicates (unless they have no words).  A document that the
mixture repeats is a row for each copy; the rows follow each other in the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordlab.llm import decontaminate, jaccard, mixing, quality, tokens
from ordlab.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of five-word similarity 0.8 or more."""
    return jaccard.one_per_class(docs, 5, 80, 100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that sources reach their target weights."""
    return mixing.mix(docs, keep=False)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token-id files and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    import public_tokenizers
    return tokens.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: the classifier's scores cannot be expressed in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
