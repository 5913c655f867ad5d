"""The inverted index as tables: postings, dictionary, document lengths, collection statistics."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.functions.stemmer import stem_column
from loomrank.functions.text import MAX_NAME, name, tokens
from loomrank.session import send_package

from .ids import number_rows

#: Terms left out of a stopped dictionary unless another list is given.
STOPWORDS = ("a", "and", "de", "der", "die", "in", "is", "la", "of", "que", "the", "to")


@dataclass
class Index:
    """postings (term, doc_id, tf), doc_stats (doc_id, doc_len), dictionary (term, term_id, df, cf), doc_names (doc_id,
    docno), stats (one row: n_docs, n_terms, total_tokens, avg_doc_len, max_df, max_cf). stemmed: terms are stems, and those of topics become stems too.
    measured: postings with doc_len, made from the texts without a shuffle; None where only a join gives the lengths.
    lengths: the part of stats that needs no dictionary (n_docs, total_tokens, avg_doc_len)."""

    postings: DataFrame
    doc_stats: DataFrame
    dictionary: DataFrame
    doc_names: DataFrame
    stats: DataFrame
    stemmed: bool = False
    measured: DataFrame | None = None
    lengths: DataFrame | None = None

    def __post_init__(self) -> None:
        self.lengths = self.stats if self.lengths is None else self.lengths

    def with_lengths(self) -> DataFrame:
        """postings with doc_len."""
        return self.postings.join(self.doc_stats, "doc_id") if self.measured is None else self.measured


def counted_terms(docs: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """(doc_id, doc_len, docno, counts) of docs (doc_id, terms, docno): counts is an array of (term, tf), of the terms of
    `only` if it is given. Terms are sorted within a text, so equal ones are a run and no rows have to meet.
    """
    # most terms are short; an octet takes no longer than a character
    cut = F.transform("terms", lambda t: F.when(F.octet_length(t) > MAX_NAME, name(t)).otherwise(t))
    words = cut if only is None else F.filter(cut, lambda t: t.isin(*only))
    rows = docs.select("doc_id", F.size("terms").cast("long").alias("doc_len"), "docno", F.sort_array(words).alias("words"))
    first = F.transform("words", lambda t, i: F.when((i == 0) | (t != F.get("words", i - 1)), i))
    rows = rows.withColumn("starts", F.array_compact(first))
    run = lambda at, i: F.struct(
        F.get("words", at).alias("term"), (F.coalesce(F.get("starts", i + 1), F.size("words")) - at).cast("long").alias("tf")
    )
    return rows.select("doc_id", "doc_len", "docno", F.transform("starts", run).alias("counts"))


def ids_are_keys(documents: DataFrame, id_col: str) -> bool:
    """Whether no id is null or shared. Reads one column."""
    ids = documents.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    return ids.filter("id IS NULL OR n > 1").isEmpty()


def build_index(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    name_col: str | None = None,
    stem: bool = False,
    persist: bool = True,
    only: Collection[str] | None = None,
) -> Index:
    """An index over documents. One pass makes the postings; everything else is an aggregate of them or of lengths.

    stem: terms are replaced by their stems, found once for each distinct term. persist: keep the two scanned tables
    (memory, then disk) for the queries of this session; a lasting index is written with sources.index_store.
    only: the (unstemmed) terms that have lists, if not all; lengths count every term. Such an index costs one pass that
    is kept as small rows of documents; its dictionary has no term_id and its stats are of those terms.
    """
    docs = documents.select(
        F.col(id_col).alias("doc_id"),
        tokens(F.col(text_col)).alias("terms"),
        name((F.col(name_col) if name_col else F.col(id_col)).cast("string")).alias("docno"),
    )
    names = docs.select("doc_id", "docno")
    rows = counted_terms(docs, only)
    if only is not None and persist:
        rows = rows.drop("docno").persist()
    # not inline: its filter of empty arrays would be pushed below the steps that make them, and written out in full there
    measured = rows.select("doc_id", "doc_len", F.inline_outer("counts")).filter("tf IS NOT NULL")
    measured = measured.select("term", "doc_id", "tf", "doc_len")
    doc_stats = rows.select("doc_id", "doc_len") if only is not None else docs.select("doc_id", F.size("terms").cast("long").alias("doc_len"))
    postings = measured.drop("doc_len")
    if stem or not ids_are_keys(documents, id_col):
        measured = None
    if stem:
        send_package(documents.sparkSession)
        stems = postings.select("term").distinct().withColumn("stem", stem_column("term"))
        postings = postings.join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))
    elif measured is None:  # documents that share an id are one in the lists
        postings = postings.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    if persist and only is None:
        postings, doc_stats = postings.persist(), doc_stats.persist()
    counted = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if only is None:
        counted = number_rows(counted, "term_id", F.desc("cf"), F.asc("term")).select("term", "term_id", "df", "cf")
        counted = counted.persist() if persist else counted
    return Index(postings, doc_stats, counted, names, collection_stats(doc_stats, counted), stem, measured, length_stats(doc_stats))


def length_stats(doc_stats: DataFrame) -> DataFrame:
    """One row."""
    return doc_stats.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_tokens"),
        F.avg("doc_len").alias("avg_doc_len"),
    )


def collection_stats(doc_stats: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row. max_df is the largest document frequency, max_cf the largest collection frequency."""
    terms = dictionary.agg(
        F.count("*").alias("n_terms"),
        F.coalesce(F.max("df"), F.lit(0)).alias("max_df"),
        F.coalesce(F.max("cf"), F.lit(0)).alias("max_cf"),
    )
    return length_stats(doc_stats).crossJoin(terms)  # one row by one row


def without_stopwords(dictionary: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """The dictionary without a short list of terms; postings stay."""
    return dictionary.filter(~F.col("term").isin(*stopwords))


def prefix_terms(dictionary: DataFrame, prefix: str) -> DataFrame:
    """Terms that start with a prefix; the filter reaches the scan of a stored dictionary."""
    return dictionary.filter(F.col("term").startswith(prefix))
