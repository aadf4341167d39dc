"""The corpus pipeline: from raw documents to token ids, one operator a stage.

Each stage works on all rows that the one before it kept. A null or empty text is a
text without words: the classifier rates it, all such texts are near copies of each
other, it holds no test item and no personal data, and has no tokens. Repeated rows
and ties are settled by row (the least doc_id stays, then the first row). An empty
table gives an empty table at every stage; further columns are kept up to the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalume.llm import bpe, decontaminate, jaccard, quality, surrogates
from catalume.llm.common import new_path, table
from catalume.llm.queries import SECRET, pattern, ranks


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; what it learns from are the labels of this table."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that SimHash links, verified, and all others of a Jaccard similarity of 0.8 or more over five-word shingles."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    return surrogates.pseudonymise(docs, SECRET, n_chars="n_chars").select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, ranks(), pattern(), keep=("doc_id", "lang", "source"), digests=True)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_distinct),
    ("benchmark decontamination", drop_leaks),
    ("PII", replace_personal_data),
    ("byte-level BPE encoding and decoding", to_tokens),
]

#: No SQL can express these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
