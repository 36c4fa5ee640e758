"""The corpus pipeline: quality rules, near copies, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlake.llm.common import documents
from flowlake.llm.decontamination import without_passages
from flowlake.llm.jaccard import keep_one
from flowlake.llm.mixing import take
from flowlake.llm.quality import keep_quality
from flowlake.llm.token_ids import token_files
from flowlake.scratch import materialize

TOKENIZER = "byte_bpe_50k.json"
# Pieces that a worker keeps, and bytes that it encodes at a time: executors hold other stages' memory too.
REMEMBERED, BATCH_BYTES = 300_000, 2 << 20
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the outlier test reject go (operator 6)."""
    return keep_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (operator 2)."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go (operator 3)."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (operator 1)."""
    return take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, copies included, in files that are read back (operator 4)."""
    return token_files(docs, public_tokenizers.path(TOKENIZER), remembered=REMEMBERED, batch_bytes=BATCH_BYTES)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources), ("token_files", write_tokens)]

# Rounded estimates, random draws and files have no SQL; the tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows of the last."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
