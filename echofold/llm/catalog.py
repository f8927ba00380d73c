"""The queries of this subpackage, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echofold.llm import bpe, gif, line_templates, masked_lm, mixing, near_dups, quality_classifier, quality_rules, url_reputation, wavelet
from echofold.llm.common import table


def op1_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(table(spark, sf_dir, "documents"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(table(spark, sf_dir, "documents"))


def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.stored_tokens(table(spark, sf_dir, "documents"))


def op6_simhash_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.report(table(spark, sf_dir, "documents"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.from_tables(*(table(spark, sf_dir, t) for t in ("pages", "documents", "labels")))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op9_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_mix_weighted_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_compression_classifier": op1_compression_classifier,
    "op2_line_templates": op2_line_templates,
    "op3_gif_media": op3_gif_media,
    "op4_masked_pseudo_likelihood": op4_masked_pseudo_likelihood,
    "op5_wavelet_shards": op5_wavelet_shards,
    "op6_simhash_small_world": op6_simhash_small_world,
    "op7_host_reputation": op7_host_reputation,
    "op8_line_frequency": op8_line_frequency,
    "op9_bpe_chunk_reuse": op9_bpe_chunk_reuse,
    "op10_mix_weighted_fair": op10_mix_weighted_fair,
}
SQL = {
    "op2_line_templates": line_templates.SQL,
    "op7_host_reputation": url_reputation.SQL,
    "op8_line_frequency": quality_rules.SQL,
    "op10_mix_weighted_fair": mixing.SQL,
}
