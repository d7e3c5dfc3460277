"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import forest, isomedia, langid, lines, minhash, mixing, negatives, paragraphs, suffix, templates, unigram, url_filter, whitening
from .common import table


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.text_media_features(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup_digest(table(spark, sf_dir, "documents"))


def op7_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digest(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.paragraph_digest(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_media_columns, op2_url_filter, op3_language_id, op4_minhash_near_dedup, op5_forest_neighbours, op6_line_dedup, op7_unigram_pieces, op8_suffix_dedup, op9_source_mixing,
        op10_paragraph_dedup, op11_embedding_whitening, op12_hard_negatives, op13_main_text,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.oracle(), "op6_line_dedup": lines.oracle(), "op9_source_mixing": mixing.oracle(), "op12_hard_negatives": negatives.oracle()}
