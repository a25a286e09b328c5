"""A corpus from raw documents: toxicity, near copies, repeated passages, benchmark leaks, token ids.

Each stage takes all that its predecessor kept, as a table that was written and read again. So what the stage before
needed on the way goes when the next one begins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.llm import bpe, decontaminate, group_join, seed_extend, toxicity
from convolens.llm import common as C

TOKENIZER = "byte_bpe_50k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Folders of the last stage's steps.
_STEPS: list[str] = []


def stage(fn: Stage) -> Stage:
    """The stage, after the steps of the one before are deleted; what `docs` itself still reads is not."""

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.delete(spark, _STEPS, docs)
        with C.watched(_STEPS):
            return fn(spark, docs, sf_dir)

    return run


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 connect, the one with the smallest id."""
    return group_join.representatives(docs)


@stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that stand in a document with a smaller id."""
    thin = seed_extend.thinned(docs)
    return thin.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies of benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to."""
    out = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("bpe", bpe_stage),
]

#: Trained models and sketches of the order of shingles are beyond SQL; tests/llm holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = C.staged(stage(spark, docs, sf_dir), name)
    return docs
