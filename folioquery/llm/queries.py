"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm import (
    alignment, caps, html_extract, minhash, mixing, packing, pii, prefix_trie, quality_classifier, quality_rules, sharding,
    token_counts, url_filter,
)
from folioquery.llm.common import own_folder, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = quality_classifier.fit(docs, quality_classifier.labelled_sample(spark, folder))
    return quality_classifier.classify(docs, model)


@_query
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(read(spark, folder, "documents"))


@_query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.tokenize(read(spark, folder, "documents")))


@_query
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"), mixing.topics(spark, folder)).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"),
    )


@_query
def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"), percent=85)


@_query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_documents(read(spark, folder, "documents"), folder)


@_query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(read(spark, folder, "documents"))


@_query
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read(spark, folder, "pages"), url_filter.train(url_filter.labelled_urls()))


@_query
def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_duplicates(read(spark, folder, "embeddings"))


@_query
def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(read(spark, folder, "pages"), html_extract.train(html_extract.training_pages()))


@_query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(read(spark, folder, "documents"))


@_query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(read(spark, folder, "conversations"))


ORACLES["op12_prefix_trie"] = prefix_trie.ORACLE


@_query
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Starts with an empty cache of its own, so that its work is that of all distinct texts."""
    return token_counts.count_tokens(read(spark, folder, "documents"), own_folder(spark, "token-counts"))
