"""Impact tables over postings: bounds by block and by range of documents, and the shapes of the lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions.scoring import idf, tf_weight

from .ids import PIECE, before, running
from .index import Index

BLOCK = 64
RANGE, LONG_LIST = 1024, 32768
#: The widths in bits that a block may be packed with.
WIDTHS = (1, 2, 3, 4, 5, 6, 8, 10, 16)


def doc_ord(doc_id: Column | str = "doc_id") -> Column:
    """Documents counted from 1."""
    return (F.col(doc_id) if isinstance(doc_id, str) else doc_id) + 1


def weights(index: Index) -> DataFrame:
    """postings with w, the weight of the frequency."""
    s = F.broadcast(index.lengths.select("avg_doc_len"))  # one row
    w = tf_weight(F.col("tf"), F.col("doc_len"), F.col("avg_doc_len"))
    return index.with_lengths().crossJoin(s).withColumn("w", w).drop("avg_doc_len")


def with_idf(rows: DataFrame, index: Index) -> DataFrame:
    """rows (term, df, ...), as few as terms, blocks or ranges, with g (idf of the term). df is right where postings were
    counted once each, else the dictionary's takes its place."""
    if index.measured is None:
        rows = rows.drop("df").join(index.dictionary.select("term", "df"), "term")
    rows = rows.crossJoin(F.broadcast(index.lengths.select("n_docs")))
    return rows.withColumn("g", idf(F.col("n_docs"), F.col("df"))).drop("n_docs", "df")


def scores(rows: DataFrame) -> DataFrame:
    """rows (max_w, min_w, g, ...) with max_score and min_score. w times g rises with w, or falls if g is negative, in
    doubles too, so these are the bounds of the postings' scores to the last bit."""
    up = F.col("g") >= 0
    high, low = F.col("max_w") * F.col("g"), F.col("min_w") * F.col("g")
    both = {"max_score": F.when(up, high).otherwise(low), "min_score": F.when(up, low).otherwise(high)}
    return rows.withColumns(both).drop("max_w", "min_w", "g")


def weighted(index: Index) -> DataFrame:
    """postings with g (idf of the term), w (weight of the frequency) and score (w times g)."""
    s = F.broadcast(index.lengths.select("n_docs"))
    out = weights(index).join(index.dictionary.select("term", "df"), "term").crossJoin(s)
    out = out.withColumn("g", idf(F.col("n_docs"), F.col("df"))).drop("n_docs")
    return out.withColumn("score", F.col("w") * F.col("g"))


def numbered(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """postings with block_no, from 0: a run of `block` postings of a term in document order."""
    rows = running(postings, "place", F.lit(1))
    return rows.withColumn("block_no", F.floor((F.col("place") - 1) / block).cast("long")).drop("place")


def block_info(index: Index, block: int = BLOCK) -> DataFrame:
    """By term and block: last document, postings, largest and smallest score. No entry is left uninitialised."""
    rows = numbered(weights(index).select("term", "doc_id", "w"), block)
    blocks = rows.groupBy("term", "block_no").agg(
        F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n"), F.max("w").alias("max_w"), F.min("w").alias("min_w")
    )
    return scores(with_idf(blocks.withColumn("df", F.sum("n").over(Window.partitionBy("term"))), index))


def term_max_score(index: Index) -> DataFrame:
    """By term: largest and smallest score of its postings. Tasks send one row a term."""
    by = weights(index).groupBy("term")
    return scores(with_idf(by.agg(F.count("*").alias("df"), F.max("w").alias("max_w"), F.min("w").alias("min_w")), index))


def doc_block_info(index: Index, size: int = RANGE, least_df: int = LONG_LIST) -> DataFrame:
    """By term of least_df documents or more and range of `size` documents: the largest weight, the last range too.

    Tasks send one row a term and range; a term's documents are counted from those rows.
    """
    rows = weights(index).withColumn("range_no", F.floor((doc_ord() - 1) / size).cast("long"))
    ranges = rows.groupBy("term", "range_no").agg(F.max("w").alias("max_w"), F.count("*").alias("n"))
    if index.measured is None:
        ranges = ranges.join(index.dictionary.select("term", "df"), "term")
    else:
        ranges = ranges.withColumn("df", F.sum("n").over(Window.partitionBy("term")))
    return with_idf(ranges.filter(F.col("df") >= least_df).drop("n"), index)


def score_quantize(ranges: DataFrame) -> DataFrame:
    """Range bounds in a byte, by floor (may understate the bound) and by ceiling (never does), and both decoded."""
    top = F.max("max_w").over(Window.partitionBy("term"))  # a term has as many rows as ranges
    q = F.round(F.col("max_w") * 255 / top, 9)  # the largest is 255 exactly
    return ranges.select(
        "term",
        "range_no",
        F.floor(q).cast("int").alias("q_floor"),
        F.ceil(q).cast("int").alias("q_ceil"),
        (top * F.floor(q) / 255).alias("decoded_floor"),
        (top * F.ceil(q) / 255).alias("decoded_ceil"),
    )


def gap_encode(postings: DataFrame) -> DataFrame:
    """Gaps between documents of a list (less one) and frequencies less one."""
    return pieced_gaps(postings).drop("piece")


def pieced_gaps(postings: DataFrame) -> DataFrame:
    """gap_encode with the pieces of the lists: what follows along the lists then needs no shuffle of its own."""
    rows = before(postings, "previous")
    gap = doc_ord() - F.coalesce(doc_ord("previous"), F.lit(0)) - 1
    return rows.select("term", "doc_id", "piece", gap.cast("long").alias("gap"), (F.col("tf") - 1).alias("tf_less"))


def gap_decode(gaps: DataFrame) -> DataFrame:
    """Documents and frequencies back from gaps in list order."""
    rows = running(gaps, "doc_ord", F.col("gap") + 1)
    return rows.select("term", "doc_ord", (F.col("tf_less") + 1).alias("tf"))


def block_bits(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """By term and block: the width that holds nine tenths of the gaps, and the bytes that the largest needs beyond."""
    gaps = numbered(pieced_gaps(postings), block)
    out = gaps.groupBy("term", "block_no").agg(
        F.sort_array(F.collect_list("gap")).alias("all"), F.count("*").alias("n"), F.max("gap").alias("max_gap")
    )  # at most `block` values a row
    cut = F.col("all")[F.greatest(F.floor(F.col("n") * 0.9) - 1, F.lit(0)).cast("int")]
    out = out.select("term", "block_no", "n", "max_gap", cut.alias("cut"))
    bits = F.lit(WIDTHS[-1])
    for width in reversed(WIDTHS[:-1]):
        bits = F.when(F.col("cut") < (1 << width), width).otherwise(bits)
    out = out.withColumn("bits", bits)
    rest = F.floor(F.col("max_gap") / F.pow(F.lit(2.0), F.col("bits")))
    extra = F.when(rest < 1 << 8, 1).when(rest < 1 << 16, 2).when(rest < 1 << 24, 3).otherwise(4)
    return out.select("term", "block_no", "n", F.col("cut").alias("cut_gap"), "max_gap", "bits", extra.alias("extra_bytes"))


def block_seek(blocks: DataFrame, targets: DataFrame, size: int = PIECE) -> DataFrame:
    """For each target (term, doc_id): the first block whose last document isn't before it, none beyond the list.

    Targets and blocks are sorted together by document, in pieces of a list, and each target takes the block that comes
    next, or the first of a later piece. The order is from the last document to the first: Spark keeps a frame that
    starts at the first row as it goes, but computes one that ends at the last row anew for every row.
    """
    marks = blocks.select("term", F.col("last_doc_id").alias("at"), F.lit(1).alias("kind"), "block_no")
    asks = targets.select("term", F.col("doc_id").alias("at"), F.lit(0).alias("kind"), F.struct(*targets.columns).alias("target"))
    rows = asks.unionByName(marks, allowMissingColumns=True).withColumn("piece", F.floor(F.col("at") / size).cast("long"))
    inside = Window.partitionBy("term", "piece").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("term").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("term", "piece").agg(F.min("block_no").alias("first"))
    pieces = pieces.select("term", "piece", F.last("first", ignorenulls=True).over(later).alias("later"))
    found = rows.withColumn("next", F.last("block_no", ignorenulls=True).over(inside)).filter("kind = 0")
    found = found.join(pieces.filter("later is not null"), ["term", "piece"], "left")
    return found.select("target.*", F.coalesce("next", "later").alias("block_no"))
