"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm import bpe, decontaminate, divergence, hard_negatives, kdtree, lm_scoring, pivot_search, prefix_trie, quality, quotes, separators, simhash, surrogates
from catalume.llm.common import table

#: Where the public vocabulary files lie.
TOKENIZERS = os.environ.get("CATALUME_TOKENIZERS", "/opt/tokenizers")
#: The free id after the last rank ends documents.
END = 50256
#: Keys surrogates; set your own.
SECRET = os.environ.get("CATALUME_SURROGATE_KEY", "example key")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks() -> str:
    return f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks(), pattern(), ids=False, digests=True)


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_documents(table(spark, sf_dir, "documents"), ranks(), pattern(), separator=END)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kdtree.kd_shards(table(spark, sf_dir, "documents"), 16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), SECRET)


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), ranks(), pattern())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalume.llm.pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_divergence_rules, op3_separator_scan, op4_quality_classifier, op5_simhash, op6_kd_sharding, op7_surrogates, op8_quotation_linking, op9_decontamination, op10_lm_scoring,
        op11_prefix_trie, op12_pivot_search, op13_hard_negatives, pipeline,
    )
}
SQL: dict[str, str] = {"op2_divergence_rules": divergence.rules_sql(), "op11_prefix_trie": prefix_trie.SQL, "op12_pivot_search": pivot_search.SQL, "op13_hard_negatives": hard_negatives.SQL}
