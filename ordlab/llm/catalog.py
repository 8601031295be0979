"""The registered queries of this package: thin wrappers that apply an operator
with its production parameters to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlab.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packed_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import fingerprints
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


@query
def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import mixing
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


@query
def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import warc
    return warc.warc_files(table(spark, sf_dir, "pages")).drop("url")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from ordlab.llm import tokens
    return tokens.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_byte_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import quality
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import jaccard
    return jaccard.classes(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


@query
def op7_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import repeats
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op8_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import langid
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


@query
def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import decontaminate
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import sharding
    return sharding.place(table(spark, sf_dir, "documents"))


@query
def op11_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from ordlab.llm import bpe
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op12_frequency_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import periodic
    return periodic.summary(table(spark, sf_dir, "documents"))


@query
def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ordlab.llm import conversations
    return conversations.damage_and_repair(table(spark, sf_dir, "conversations"))


def _sql():
    from ordlab.llm import mixing, warc
    SQL["op2_poisson_mix"] = mixing.SQL
    SQL["op3_warc_dictionary"] = warc.SQL


_sql()
