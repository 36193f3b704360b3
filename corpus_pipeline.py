"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the
last returns a row per document with its place in the training mix. run() writes each stage's result to the shared
folder and reads it back, so a lost executor costs the stage that it was working on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import bm25_decon, curriculum_mix, line_align, minhash_bbit, quality_pu
from chronoloom.llm.common import materialize, table
from chronoloom.session import shipping


@shipping
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.quality_stage(docs, table(spark, sf_dir, "labels"))


@shipping
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_align.line_dedup_stage(docs)


@shipping
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_bbit.near_dedup_stage(docs)


@shipping
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bm25_decon.decon_stage(docs, table(spark, sf_dir, "benchmark"))


@shipping
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum_mix.mix_stage(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: The classifier, patience diff and MinHash aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
