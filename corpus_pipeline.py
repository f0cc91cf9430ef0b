"""Corpus preparation: language filter, quality filter, near-duplicate removal, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.config import delete_scratch, scratch_path, scratch_scope
from textloom.llm.langid import keep_known_languages
from textloom.llm.packing import pack
from textloom.llm.quality import keep_good
from textloom.llm.simhash import keep_one_per_group
from textloom.sources.io import read_table

TOKENIZER = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return keep_known_languages(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the documents that came this far."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one_per_group(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language_stage), ("quality", quality_stage), ("near duplicates", dedup_stage), ("packing", packing_stage)]

#: Language models, the discriminant and SimHash aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again by the next.

    What a stage needed besides its result, and the result before it, go as soon as its own result is written.
    """
    docs, before = read_table(spark, f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        if before:
            delete_scratch(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
