"""Registered queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm import (
    chat,
    embeddings,
    html_text,
    lang_id,
    lm_scoring,
    media,
    mixing,
    packing,
    secrets,
    simhash,
    suffix_dedup,
    vector_codes,
    whitening,
)
from flowquarry.llm.common import crc_fold, read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = lang_id.fit(docs.where(crc_fold(F.col("doc_id")) != 2))
    found = docs.select("doc_id", (crc_fold(F.col("doc_id")) == 2).alias("held_out"), lang_id.language(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_media(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return lm_scoring.cross_entropy_difference(read_table(spark, sf_dir, "documents", "doc_id", "text"), good)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(read_table(spark, sf_dir, "documents", "doc_id", "text")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(found.fp).alias("fingerprint"), "component_id")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.document_rates(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels"))
    every = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select("doc_id", "n_tokens", *[f"p_{d}" for d in mixing.DOMAINS], "rate")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.reply_pairs(read_table(spark, sf_dir, "conversations")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def queries() -> dict[str, Query]:
    found = (
        op1_language_id,
        op2_best_fit_packing,
        op3_media_columns,
        op4_lm_scoring,
        op5_secret_scan,
        op6_simhash_near_dedup,
        op7_embedding_near_dedup,
        op8_mixing,
        op9_chat_formatting,
        op10_html_extraction,
        op11_suffix_array_dedup,
        op12_embedding_whitening,
        op13_vector_codes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secret_scan": secrets.oracle(),
        "op7_embedding_near_dedup": embeddings.oracle(),
        "op9_chat_formatting": chat.oracle(),
        "op11_suffix_array_dedup": suffix_dedup.oracle(),
        "op13_vector_codes": vector_codes.oracle(),
    }
