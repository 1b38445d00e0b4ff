"""Corpus preparation: reject, deduplicate, mix and pack documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import dedup_index, mixing, ngram_join, packing, quality
from pathloom.llm.common import documents, drop_stored, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts.

    Null and empty texts are scored like others; rows that repeat an identifier are judged each by its own text; an empty table stays empty.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier stays.

    A null text equals an empty one. Of rows that repeat the smallest identifier one stays; a null identifier stays only where its group has no other.
    """
    return dedup_index.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the smallest identifier.

    Texts without words are similar to none and stay. Rows that repeat the smallest identifier stay together; rows without one stay where their group has none.
    """
    return ngram_join.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for.

    A null source is a source; null texts have no size and are drawn like others; rows that repeat identifier and text share their coin. An empty table stays empty.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens with their boundary records.

    A null text is its end token alone; repeated rows are packed each for itself; an empty table gives no piece.
    """
    return packing.packed(docs)


STAGES = [("quality_filter", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", pack)]

#: Learned scores and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; each stage is written and read again before the next, and goes once that is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
