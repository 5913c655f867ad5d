"""From topics to matches and tiers. A batch of topics is one job; every table is keyed by topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions.scoring import BM25, Scorer
from loomrank.functions.stemmer import stem, stem_column
from loomrank.session import send_package

from .index import Index

#: Tier scores and final scores are compared after rounding, so that sums in another order tie alike.
DIGITS = 6
#: Rows up to which a batch of topics is held by the driver and broadcast; a larger one stays a table.
SMALL = 100_000


def if_small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has at most SMALL rows, else as it is. Cheap for what came from the driver."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def term_lookup(topics: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Topics with term_id and df, 0 for an unknown term."""
    found = topics.join(dictionary.join(if_small(topics.select("term").distinct()), "term", "left_semi"), "term", "left")
    return found.select("topic", "pos", "term", "qtf", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("term_id", "df")])


def stem_topics(topics: DataFrame) -> DataFrame:
    """Topics with stemmed terms; equal stems stay apart, as their terms were."""
    spark = topics.sparkSession
    if topics.limit(SMALL + 1).count() <= SMALL:
        rows = [(r.topic, r.pos, stem(r.term), r.qtf) for r in topics.collect()]
        return spark.createDataFrame(rows, topics.schema)
    send_package(spark)
    terms = topics.select("term").distinct().withColumn("stem", stem_column("term"))
    return topics.join(terms, "term").select("topic", "pos", F.col("stem").alias("term"), "qtf")


def query_plan(topics: DataFrame, index: Index, scorer: Scorer = BM25) -> DataFrame:
    """Known terms of each topic, rarest first, with suffix_g: the most that the terms from here on can add.

    Over a stemmed index, terms are stemmed first.
    """
    topics = stem_topics(topics) if index.stemmed else topics
    few = topics.limit(SMALL + 1).count() <= SMALL
    terms = index.dictionary.join(F.broadcast(topics) if few else topics, "term")
    terms = terms.crossJoin(F.broadcast(index.lengths.select("n_docs")))
    terms = terms.withColumn("g", scorer.term(F.col("n_docs"), F.col("df"), F.col("qtf")))
    order = Window.partitionBy("topic").orderBy(F.desc("g"), "term", "pos")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    plan = terms.select(
        "topic", "pos", "term", "qtf", "df", "g",
        F.row_number().over(order).cast("long").alias("rank"),
        F.sum(F.greatest("g", F.lit(0.0))).over(rest).alias("suffix_g"),
    )
    # at most as many rows as the topics: found once, then planned with as a table of known size
    return topics.sparkSession.createDataFrame(plan.collect(), plan.schema) if few else plan


def term_postings(plan: DataFrame, index: Index) -> DataFrame:
    """The postings of each topic's terms. Postings are filtered by the terms before anything else is joined."""
    return index.postings.join(if_small(plan), "term")


def measured_postings(plan: DataFrame, index: Index) -> DataFrame:
    """term_postings with doc_len. If lengths don't come with the postings, they are joined to the filtered ones."""
    if index.measured is None:
        return term_postings(plan, index).join(index.doc_stats, "doc_id")
    return index.measured.join(if_small(plan), "term")


def matches(plan: DataFrame, index: Index, scorer: Scorer = BM25) -> DataFrame:
    """(topic, doc_id, tier, mask, n_matched, score) of every document that has a term of the topic.

    One aggregate of partial sums over (topic, doc_id): the union of the lists, the matched subset as bits, its tier
    score, and the sum of the scorer's weights (BM25 unless another is given, to the plan as well).
    """
    s = F.broadcast(index.lengths.select("avg_doc_len"))
    rows = measured_postings(plan, index).crossJoin(s)
    w = scorer.posting(F.col("tf"), F.col("doc_len"), F.col("avg_doc_len"))
    return rows.groupBy("topic", "doc_id").agg(
        F.round(F.sum("g"), DIGITS).alias("tier"),
        F.sum(F.pow(F.lit(2.0), F.col("pos"))).cast("long").alias("mask"),
        F.count("*").alias("n_matched"),
        F.round(F.sum(w * F.col("g")), DIGITS).alias("score"),
    )


def and_match(found: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents that have all known terms of the topic."""
    sizes = plan.groupBy("topic").agg(F.count("*").alias("n_terms"))
    return found.join(if_small(sizes), "topic").filter("n_matched = n_terms").drop("n_terms")


def tier_masks(found: DataFrame) -> DataFrame:
    """The subsets of a topic's terms that documents match exactly, with how many do."""
    return found.groupBy("topic", "mask", "tier").agg(F.count("*").alias("cnt"))


def tier_counts(found: DataFrame) -> DataFrame:
    """Tiers by falling score with prior: how many documents are in better tiers. Tiers are as few as term subsets."""
    counts = found.groupBy("topic", "tier").agg(F.count("*").alias("cnt"))
    better = Window.partitionBy("topic").orderBy(F.desc("tier")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("prior", F.coalesce(F.sum("cnt").over(better), F.lit(0)))


def tier_prune(found: DataFrame, k: int) -> DataFrame:
    """Documents of the shortest run of best tiers that holds k of them."""
    kept = tier_counts(found).filter(F.col("prior") < k).select("topic", "tier")
    return found.join(F.broadcast(kept), ["topic", "tier"])


def essential_terms(found: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """Which terms still can bring new documents into the kept tiers.

    A document first met at the term of some rank has a tier score of at most suffix_g; if the best dropped tier beats
    that strictly, no such document is kept. Negative weights count as none in the bound, so nothing is lost.
    """
    dropped = tier_counts(found).filter(F.col("prior") >= k).groupBy("topic").agg(F.max("tier").alias("threshold"))
    out = plan.join(F.broadcast(dropped), "topic", "left")
    return out.select(
        "topic", "term", "rank", "suffix_g", "threshold",
        (F.col("threshold").isNull() | (F.round("suffix_g", DIGITS) >= F.col("threshold"))).alias("essential"),
    )
