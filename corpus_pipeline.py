"""The corpus pipeline: documents through the stages of STAGES, in order.

Every stage works on all rows its predecessor kept and its decisions take
effect. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillwatch.llm import bpe, decontaminate, langid, line_dedup, simhash
from tillwatch.session import Scratch, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labelled ones know: half their character runs common there, score 0.4 or more."""
    return langid.accepted(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three lines or 50 words in a row are cut out; documents left without a line go."""
    return line_dedup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark windows go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe", encoding),
]

#: SQL can express neither the classifier nor the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held: Scratch | None = None
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        scratch = Scratch(spark)
        docs = settle(made) if k == len(STAGES) - 1 else scratch.settle(made)
        if held:
            held.close()  # the next table is written, this one has no reader left
        held = scratch
    return docs
