"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, langid, manifest, mixing, negatives, packing, passages, pii, simhash, tokencounts, topk, toxicity, urlfilter
from .common import table


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_lines(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.deduplicated(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_topk": op7_topk,
    "op8_nearest": op8_nearest,
    "op9_mixing": op9_mixing,
    "op10_urls": op10_urls,
    "op11_manifest": op11_manifest,
    "op12_passages": op12_passages,
    "op13_negatives": op13_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op7_topk": topk.SQL,
    "op9_mixing": mixing.SQL,
    "op11_manifest": manifest.SQL,
    "op12_passages": passages.SQL,
    "op13_negatives": negatives.SQL,
}
