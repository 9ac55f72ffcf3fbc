"""The corpus pipeline: language, shared lines, near copies, repeated passages, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from twinline.llm import langid, linediff, nearcopies, packing, suffixes
from twinline.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, and undecided ones, go."""
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that they share with earlier documents; texts of which nothing is left go."""
    return linediff.dedup_lines(docs).select(*docs.columns).where("text <> ''")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, an exact similarity of 0.8 and more."""
    return nearcopies.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that earlier documents hold; texts of which nothing is left go."""
    return suffixes.dedup_passages(docs).where("text <> ''")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", sequences)]
#: The language stage is a trained network, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
