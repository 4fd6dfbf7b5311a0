"""The operators as queries over the given tables: ``QUERIES`` and, where it exists, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ringsight.llm import (
    ann_tree,
    chat_format,
    crf_quality,
    filter_audit,
    license_scan,
    packing,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    toxicity,
    url_filter,
    vector_codes,
)

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}

#: Fixed values.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(quality_rules.oracle())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(url_filter.oracle(URL_RULES))
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


@query()
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query()
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(chat_format.oracle())
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_format.render(table(spark, sf_dir, "conversations"))
    digest = F.sha2(F.col("rendered").cast("binary"), 256).alias("sha256")
    return found.select("conv_id", "turn", "role", "nth", "start", F.length("rendered").cast("long").alias("n_chars"), digest)


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(filter_audit.oracle())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(vector_codes.oracle())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
