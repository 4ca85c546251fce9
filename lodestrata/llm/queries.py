"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, common, decontaminate, html_text, language_id, language_model, licence_scan, piece_transducer, quality, sharding, simhash, token_frames, topk, whitening


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(common.table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"), tau=4, width=4)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(common.table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(common.table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.sentencepiece(common.table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return token_frames.token_output(docs, common.tokenizer_path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(common.table(spark, sf_dir, "documents"), shards=8)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"), components=32)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages"), repeats=True)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return alignment.align(docs, common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_licence_scan, op2_simhash, op3_top_k, op4_language_model, op5_language_id, op6_sentencepiece, op7_token_output, op8_quality, op9_sharding,
        op10_decontamination, op11_whitening, op12_html_text, op13_tokenizer_alignment,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": topk.SQL, "op10_decontamination": decontaminate.SQL}
