"""The corpus pipeline: documents by language, by quality, without copies, without near copies, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import stages
from mnemospark.llm.common import table
from mnemospark.llm.packing import best_fit_packing
from mnemospark.session import finished, mark


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_known_language(docs, public_tokenizers.path("piece_bpe_32k.model"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_good_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_near_copies(docs, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A smaller cache than the operator's own: these workers run beside a heap that earlier stages have grown.
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, cache=500_000)


STAGES = [("language", language), ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Language, quality and packing are models and searches that SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = mark()
        docs = finished(stage(spark, docs, sf_dir), f"pipeline-{name}", before)  # a stage's own tables go with it
    return docs
