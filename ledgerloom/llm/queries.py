"""The numbered queries over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import direct, elkan, embeddings, html, langid, merkle, minhash, packing, preference, quality, secrets, sharding, tokens
from .common import read_table


def op1_itq_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(read_table(spark, sf_dir, "documents"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return preference.format_preferences(conversations, preference.neighbour_pairs(conversations))


def op7_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.judged(docs, labels).select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokens.token_report(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.languages_of(docs).select("doc_id", "held_out", "lang_pred", "score")


def op11_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direct.tokens_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(read_table(spark, sf_dir, "documents"))


def op13_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.codes_report(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_itq_hamming,
        op2_label_propagation,
        op3_html_density,
        op4_secret_worklist,
        op5_lsh_forest,
        op6_preference_pairs,
        op7_isolation_forest,
        op8_hilbert_packing,
        op9_prefix_bpe,
        op10_byte_gru,
        op11_direct_codes,
        op12_merkle_manifest,
        op13_elkan_codes,
    )
}

SQL: dict[str, str] = {
    "op6_preference_pairs": preference.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_elkan_codes": elkan.SQL,
}
