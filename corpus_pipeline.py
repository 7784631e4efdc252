"""From raw documents to packed training sequences: five stages, each written and read again before the next.

quality         drops the documents that the line chain rejects
near_dedup      keeps one document of each class of near-duplicates
decontamination drops the documents that hold a stretch of a benchmark item
personal_data   replaces personal data and secrets by their kind
packing         turns what is left into sequences of token pieces
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnfell.llm.decontamination import without_benchmark
from tarnfell.llm.near_dedup import one_of_each
from tarnfell.llm.packing import packed
from tarnfell.llm.pii import redacted, train_detector
from tarnfell.llm.quality import keep_good, train_quality
from tarnfell.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs, train_detector(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
#: SQL can't express a trained stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
