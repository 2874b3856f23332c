"""From raw documents to packed sequences: the stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.llm.line_dedup import line_dedup
from gritsieve.llm.mixing import mixed_documents
from gritsieve.llm.packing import TOKENIZER, pack
from gritsieve.llm.quality_rules import quality_rules
from gritsieve.llm.shared import WORD, delete, new_path, table, watched
from gritsieve.llm.simhash import one_of_each_group

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the stage before stored for itself. Its result is written before the next stage begins, so they can go then.
_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    """A stage that first deletes what the one before it left behind."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        delete(spark, _left)
        with watched() as made:
            out = stage(spark, docs, folder)
        _left[:] = made
        return out

    return run_stage


@tidy
def keep_by_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs, table(spark, folder, "labels")).where("kept").select(docs.columns)


@tidy
def cut_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the runs of lines an earlier one has; those left without a word go. n_chars follows the text."""
    out = line_dedup(docs).where((F.col("n_cut") == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@tidy
def keep_one_of_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each SimHash group."""
    return one_of_each_group(docs)


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it; n_chars follows the text."""
    out = mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", keep_by_quality),
    ("line_dedup", cut_repeated_lines),
    ("simhash", keep_one_of_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes of n-grams, fingerprints and tokens have no counterpart in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written as Parquet to the shared folder and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
