"""A corpus pipeline: quality rules, exact and near deduplication, redaction of secrets, packing into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; run() writes each stage's
result as Parquet in the shared folder and reads it back for the next, so a lost executor costs one stage at most.

Cases, by stage. A null or blank text fails the base rules and goes with the first stage, so the others see none, but
take it as empty. Texts of any length pass whole. Without labelled rows of both kinds no rule is learned, and the base
rules alone decide. Of equal texts the smallest id stays, and of rows that share that id one; near copies likewise,
where rows that share an id are one document. A null id is kept by near deduplication and packed like any other.
Extra columns of any name pass all stages but the last, which returns its own. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm import exact_dedup, minhash_dedup, packing, quality_rules, secret_scan
from loomrank.llm.common import free_name, stage

#: No SQL expresses learned rules, min-max hashing and byte-pair encoding; tests hold run() against plain Python.
ORACLE_SQL = None

TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.apply_rules(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the smallest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8 or more) the document of the smallest id."""
    return minhash_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where there were any."""
    old = free_name(docs, "old")
    out = secret_scan.redact(docs.withColumn(old, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(old))
    n = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).drop(old)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
