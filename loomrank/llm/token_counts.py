"""Token counts with a digest cache.

Each text's normalised content is digested (SHA-256) on the JVM and joined with stored counts by (content digest,
tokenizer digest). Only distinct misses are encoded, once each, and their counts are appended to the cache, a Parquet
table in the shared folder. A tokenizer's digest is that of its file, so another version never meets old counts.

The cache may be appended to by several jobs at once: counts are a function of the two digests, so repeated entries
agree and reading takes one of them.

Cases: a null text counts as empty; repeated texts are encoded once; texts of any length are encoded whole; null and
repeated ids are rows like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, fresh_path, whole_text
from .tokenizing import encoder, file_digest, slices

CACHE_SCHEMA = "digest binary, tokenizer binary, n_tokens long"


def _encode(path: str, version: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text"):
            n = pa.array(enc.counts(b.column("text")), pa.int64())
            yield pa.record_batch(
                [b.column("digest"), pa.array([version] * b.num_rows, pa.binary()), n], ["digest", "tokenizer", "n_tokens"]
            )

    return run


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts, one row a pair of digests; none yet: empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens. Appends the misses to the cache at cache_path.

    normalise: a function under which a text's count doesn't change; none by default.
    """
    python_ready(docs.sparkSession)
    spark = docs.sparkSession
    version = bytes.fromhex(file_digest(tokenizer_path))
    text = whole_text(text_col)
    text = normalise(text) if normalise else text
    stored = read_cache(spark, cache_path).filter(F.col("tokenizer") == F.lit(version)).select("digest", "n_tokens")
    content = docs.select(text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # partial aggregation leaves at most one copy of a text per task before the shuffle
    distinct = content.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored.select("digest"), "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    now = read_cache(spark, cache_path).filter(F.col("tokenizer") == F.lit(version))
    now = now.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(
        F.col(id_col), F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    counted = F.coalesce("n_tokens", F.raise_error(F.lit("a text has no count in the cache")).cast("long"))
    return rows.join(now, "digest", "left").select(id_col, "n_bytes", counted.alias("n_tokens"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts by word_bpe_49k.json over a cache of this run's own, so that every text is a miss the first time."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = fresh_path(spark, "token-cache")
    counts = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
