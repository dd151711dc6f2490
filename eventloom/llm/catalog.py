"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip_report
from .common import table
from .hosts import HOST_SQL, filter_urls
from .language import language_report
from .lines import LINE_SQL, line_report
from .mixing import MIX_SQL, mix_sources
from .negatives import NEGATIVES_SQL, mine_negatives
from .packing import pack_documents
from .quality import score_documents
from .search import SEARCH_SQL, search_items
from .secrets import secret_report
from .simhash import component_report
from .sketches import edited_report

from .vamana import nearest_report


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_report(table(spark, sf_dir, "documents"))


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_report(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_report(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(table(spark, sf_dir, "embeddings"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}


def llm_oracle() -> dict[str, str]:
    return {
        "op1_line_dedup": LINE_SQL,
        "op6_url_filter": HOST_SQL,
        "op11_mixing": MIX_SQL,
        "op12_search": SEARCH_SQL,
        "op13_hard_negatives": NEGATIVES_SQL,
    }
