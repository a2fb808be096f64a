"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import line_crf, queries
from pulseframe.llm.decontam import drop_contaminated
from pulseframe.llm.mixing import mixed
from pulseframe.llm.near_dup import drop_near_duplicates
from pulseframe.llm.scratch import written
from pulseframe.llm.sharding import sharded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores below 0.3 go. Null and empty texts are one empty line and judged like others; all columns stay as they are."""
    return line_crf.keep_good(docs, queries.quality_model(spark, sf_dir), least=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, also where a doc_id or a row is repeated. Texts without words, null ones included, all stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a 10-word window of a benchmark item occurs go. Null and empty texts and an empty benchmark drop nothing."""
    return drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"), width=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped until each source has its share of words. Null and blank texts have none and go; a null source is one of its own."""
    return mixed(docs, weights=(5.0, 2.0, 1.0), share=1.5, cap=2)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 16 shards of nearly equal bytes: documents' columns, shard and slot. Null texts are empty ones; an empty mix has no rows."""
    return sharded(docs, n_shards=16)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: The stages train a classifier and solve for weights iteratively, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
