"""The queries of this package: each operator on its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import table
from .digest import digests
from .html import main_texts
from .mixing import mixed
from .neighbours import nearest
from .packing import packed_documents
from .quality import quality_scores
from .simhash import simhash_components
from .suffix import without_repeats
from .tokens import token_counts
from .urls import url_verdicts

#: The rules of op8: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES)


def op9_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op10_digest_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash_components": op2_simhash_components,
    "op3_mixed_sources": op3_mixed_sources,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_token_counts": op5_token_counts,
    "op6_quality_scores": op6_quality_scores,
    "op7_packed_documents": op7_packed_documents,
    "op8_url_verdicts": op8_url_verdicts,
    "op9_main_texts": op9_main_texts,
    "op10_digest_likeness": op10_digest_likeness,
}

ORACLES: dict[str, str] = {"op8_url_verdicts": sql.url_verdicts(RULES)}
