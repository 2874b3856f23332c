"""The registered queries of the operators: `(spark, sf_dir) -> DataFrame` over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gritsieve.llm.embeddings import similar_vectors
from gritsieve.llm.html_extract import main_texts
from gritsieve.llm.licenses import license_scan
from gritsieve.llm.line_dedup import line_dedup
from gritsieve.llm.mixing import mix_counts
from gritsieve.llm.oracles import ORACLES
from gritsieve.llm.packing import TOKENIZER, pack
from gritsieve.llm.pii import personal_data_digest
from gritsieve.llm.prefix_trie import prefix_trie
from gritsieve.llm.quality_classifier import classify
from gritsieve.llm.quality_rules import quality_rules
from gritsieve.llm.shared import table
from gritsieve.llm.simhash import simhash_groups
from gritsieve.llm.spelling import spelling_variants
from gritsieve.llm.warc import pages_through_warc


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_counts(table(spark, folder, "documents")).drop("text_hash")


def op3_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors(table(spark, folder, "embeddings"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Sources stand for hosts, their languages for paths."""
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return pages_through_warc(table(spark, folder, "pages"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data_digest(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_cut")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"), keep=["doc_id"])


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op12_html(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_mixing, op3_embeddings, op4_simhash, op5_quality, op6_licenses, op7_warc, op8_pii, op9_line_dedup,
    op10_quality_rules, op11_spelling, op12_html, op13_prefix_trie,
)}
__all__ = ["ORACLES", "QUERIES"]
