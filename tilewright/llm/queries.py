"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, html_blocks, kneser_ney, langid, media, oracles, packing, repetition, setsketch, substring, token_store


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_store.read_store(token_store.store_documents(_documents(spark, sf_dir), path, end_id=1, vocabulary=49408))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row")


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(byte_bpe.encoded(_documents(spark, sf_dir), ranks, pattern), ranks, pattern)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = langid.train(docs.filter(langid.fold() != 2))
    held_out = F.coalesce(langid.fold() == 2, F.lit(False))
    return langid.identify(docs.withColumn("held_out", held_out), profiles, keep=("held_out",))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_quality(_documents(spark, sf_dir)).drop("dup_line_chars", "top_chars", "dup_chars")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_documents(spark, sf_dir)).drop("row")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (pipeline, op1_token_store, op2_kneser_ney, op3_html_blocks, op4_byte_bpe, op5_substring, op6_language_id, op7_packing, op8_repetition, op9_near_duplicates, op10_media)}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring": oracles.SUBSTRING, "op8_repetition": oracles.repetition(), "op9_near_duplicates": oracles.NEAR_DUPLICATES}
