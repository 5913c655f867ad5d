"""An index as Parquet tables in a folder, and named sets of impact tables beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators import impact
from loomrank.operators.index import Index

TABLES = ("postings", "doc_stats", "dictionary", "doc_names", "stats")


def save_index(index: Index, path: str) -> None:
    """Postings are range-partitioned and sorted by (term, doc_id), so a term's filter skips files and row groups."""
    n = int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["term", "doc_id"]
    index.postings.repartitionByRange(n, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/postings")
    index.dictionary.repartitionByRange(max(1, n // 4), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(
        f"{path}/dictionary"
    )
    for name in ("doc_stats", "doc_names"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    stats = index.stats.withColumn("stemmed", F.lit(index.stemmed))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> Index:
    tables = [spark.read.parquet(f"{path}/{name}") for name in TABLES]
    stemmed = bool(tables[-1].select("stemmed").first()[0])
    return Index(*tables[:-1], tables[-1].drop("stemmed"), stemmed)


def save_ranges(
    index: Index, path: str, name: str, size: int = impact.RANGE, least_df: int = impact.LONG_LIST
) -> None:
    """Bounds by range of documents under a name, with the size of a range and how many ranges a list spans."""
    last = index.doc_stats.agg(F.max("doc_id")).first()[0]
    n = 0 if last is None else last // size + 1
    bounds = impact.doc_block_info(index, size, least_df)
    bounds.repartition("term").sortWithinPartitions("term", "range_no").write.mode("overwrite").parquet(f"{path}/impacts/{name}/ranges")
    about = index.postings.sparkSession.createDataFrame([(size, n, least_df)], "range_size long, n_ranges long, least_df long")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/impacts/{name}/ranges_about")


def load_ranges(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, int, int]:
    """(term, range_no, max_w, g) of a name, the size of a range, and how many there are."""
    about = spark.read.parquet(f"{path}/impacts/{name}/ranges_about").first()
    return spark.read.parquet(f"{path}/impacts/{name}/ranges"), about.range_size, about.n_ranges


def save_impacts(index: Index, path: str, name: str, block: int = impact.BLOCK) -> None:
    """Block bounds of a name; several may lie side by side."""
    impact.block_info(index, block).write.mode("overwrite").parquet(f"{path}/impacts/{name}/blocks")
    impact.term_max_score(index).write.mode("overwrite").parquet(f"{path}/impacts/{name}/terms")


def load_impacts(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, terms) of a name."""
    return tuple(spark.read.parquet(f"{path}/impacts/{name}/{t}") for t in ("blocks", "terms"))


def posting_list(index: Index, term: str) -> DataFrame:
    """One term's list in document order; the filter reaches the scan of a stored index."""
    return index.postings.filter(F.col("term") == term).orderBy("doc_id")


def doc_length(index: Index, doc_id: int) -> int:
    """A document's length, 0 if there is no such document."""
    row = index.doc_stats.filter(F.col("doc_id") == doc_id).first()
    return row.doc_len if row else 0


def doc_name(index: Index, doc_id: int) -> str:
    """A document's name, empty if there is no such document."""
    row = index.doc_names.filter(F.col("doc_id") == doc_id).first()
    return row.docno if row else ""


def term_of(index: Index, term_id: int) -> str:
    """The term of a number, empty if there is none."""
    row = index.dictionary.filter(F.col("term_id") == term_id).first()
    return row.term if row else ""


def posting_list_of(index: Index, term_id: int) -> DataFrame:
    """The list of the term of a number."""
    return posting_list(index, term_of(index, term_id))
