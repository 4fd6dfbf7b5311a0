"""From raw documents to packed training sequences.

Each stage takes what the one before kept and its decision takes effect: documents that the quality classifier rejects go, then those
that the quality rules reject, then near copies (of each group one stays), then passages that an earlier document has; what
is left is packed. Stages are written between, so each is computed once.

Columns beyond those of documents pass every stage but the last, whatever their names. Rows without doc_id can't be compared with
others and pass the dedup stages unchanged. An empty table gives empty stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ringsight.llm import crf_quality, near_copies, packing, quality_rules, substring_dedup
from ringsight.llm.stages import collecting, remove, settle_compact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf_quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def regular_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose nothing stay as they are, the others are their kept words, joined by a space."""
    return substring_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("quality rules", regular_documents),
    ("simhash near-dedup", distinct_documents),
    ("substring dedup", without_repeats),
    ("packing", packed),
]

#: The classifier, the fingerprint components and the packing plan are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents. Once a stage is written, what it read and what it wrote on its way go; the folders that the
    result reads stay, so results of several runs can be read in any order."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, plan in STAGES[:-1]:
        written: list[str] = []
        with collecting(written):
            docs = settle_compact(plan(spark, docs, sf_dir))
        remove(spark, read + written[:-1])
        read = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
