"""Ranked results: exhaustive, pruned and ranked again, tier by tier; counters and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions.scoring import dirichlet, tf_weight

from .index import Index
from .match import DIGITS, if_small, measured_postings, tier_counts, tier_prune


def _top(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each topic. Spark limits each task's rows to k a topic before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(*order, F.asc("doc_id")))
    top = found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
    return top.select("topic", "rank", "doc_id", F.col("tier").alias("tier_score"), "score")


def bm25_exact(found: DataFrame, k: int) -> DataFrame:
    """The best k of all matches."""
    return _top(found, k, F.desc("score"))


def bm25_rerank(found: DataFrame, k: int) -> DataFrame:
    """The best k of the kept tiers."""
    return _top(tier_prune(found, k), k, F.desc("score"))


def bm25_tiered(found: DataFrame, k: int) -> DataFrame:
    """The best k by tier, then score. Pruning drops nothing that this order would return."""
    return _top(tier_prune(found, k), k, F.desc("tier"), F.desc("score"))


def eval_counts(found: DataFrame, k: int) -> DataFrame:
    """By topic: documents matched, documents of kept tiers, tiers and kept tiers."""
    kept = F.col("prior") < k
    return (
        tier_counts(found)
        .groupBy("topic")
        .agg(
            F.sum("cnt").alias("matched"),
            F.sum(F.when(kept, F.col("cnt")).otherwise(0)).alias("evaluated"),
            F.count("*").alias("tiers"),
            F.sum(F.when(kept, 1).otherwise(0)).alias("kept_tiers"),
        )
    )


def score_accumulate(scored: DataFrame, k: int) -> DataFrame:
    """Scores of a document added up over whatever rows carry it, and the k largest sums."""
    total = scored.groupBy("doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"), F.count("*").alias("parts"))
    return total.orderBy(F.desc("score"), "doc_id").limit(k)


def run_output(ranked: DataFrame, doc_names: DataFrame) -> DataFrame:
    """(topic, rank, docno, score), names joined to the final rows only."""
    return doc_names.join(F.broadcast(ranked), "doc_id").select("topic", "rank", "docno", "score")


def language_model(plan: DataFrame, index: Index, k: int, mu: float = 2500.0) -> DataFrame:
    """Opt-in: query likelihood with Dirichlet smoothing over documents that have a term of the topic."""
    total = F.broadcast(index.lengths.select("total_tokens"))
    terms = plan.join(index.dictionary.select("term", "cf"), "term").select("topic", "term", "cf")
    rows = index.postings.join(if_small(terms), "term")
    found = rows.select("topic", "doc_id").distinct().join(if_small(terms), "topic")
    found = found.join(rows.select("topic", "doc_id", "term", "tf"), ["topic", "doc_id", "term"], "left")
    found = found.join(index.doc_stats, "doc_id").crossJoin(total)
    value = dirichlet(F.coalesce("tf", F.lit(0)), F.col("doc_len"), F.col("cf"), F.col("total_tokens"), mu)
    scored = found.groupBy("topic", "doc_id").agg(F.round(F.sum(value), DIGITS).alias("score"))
    return _top(scored.withColumn("tier", F.lit(None).cast("double")), k, F.desc("score"))


def bm25_weights(plan: DataFrame, index: Index) -> DataFrame:
    """The weight of each posting of the topics' terms."""
    s = F.broadcast(index.lengths.select("avg_doc_len"))
    rows = measured_postings(plan, index).crossJoin(s)
    w = tf_weight(F.col("tf"), F.col("doc_len"), F.col("avg_doc_len"))
    return rows.select("topic", "term", "doc_id", "tf", w.alias("w"), (w * F.col("g")).alias("score"))
