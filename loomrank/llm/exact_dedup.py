"""Exact deduplication by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts, an external sort puts equal texts next to each other, and
full comparisons of neighbours (the run boundaries of a sorted window) form the groups.

Splitters are drawn over (leading characters, 64-bit hash, salt), so that the sample at the driver stays small
whatever the length of the texts, and texts with a common head still spread; equal texts are equal in all three, hence
adjacent. Texts held by more rows than a task should sort are found beforehand by counting hashes (a map-side
combined count of all rows) and are salted by row; their few pieces are put together by SHA-256.

Cases: a null text counts as empty; repeated rows and null ids are rows like any other (a null id is never preferred
to another id, and is the kept one only in a group without any); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, parts, stage

HEAD = 32


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: which id of a group stays, "smallest" or "largest". normalise: applied to the text first (none: as it is).
    rows_per_task: groups above it are salted; by default a quarter of a shuffle partition's mean share.
    """
    base = docs.select(F.col(id_col).alias("__id"), _normal(F.col(text_col), normalise).alias("__t"))
    rows = _sorted(base, F.col("__t"), keep, rows_per_task).select(
        "__id", "__salt", "__lead", "__size", "__first", F.sha2("__t", 256).alias("text_sha256")
    )
    rows = stage(rows, "dedup-rows")
    out = rows.join(F.broadcast(_salted_groups(rows, keep)), _same_salted(rows), "left")
    keep_id = F.when(F.col("__gs").isNotNull(), F.col("__g")).otherwise(F.col("__lead"))
    return out.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("__gs", "__size").cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """One whole row of docs, all its columns with it, for each group of equal texts.

    The columns travel with the texts, once, so nothing is joined back; of rows that repeat the kept id one stays.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.struct("*").alias("__row"))
    text = _normal(F.col("__row").getField(text_col), normalise)
    leads = _sorted(base, text, keep, rows_per_task).filter("__first")
    leads = stage(leads.select("__id", "__salt", "__lead", "__size", "__row", F.sha2("__t", 256).alias("text_sha256")), "dedup-leads")
    out = leads.join(F.broadcast(_salted_groups(leads.withColumn("__first", F.lit(True)), keep)), _same_salted(leads), "left")
    best = Window.partitionBy("text_sha256", "__salted").orderBy(F.col("__id").desc_nulls_last() if keep == "largest" else F.col("__id").asc_nulls_last(), "__salt")
    # the pieces of one salted text are few (its rows / rows_per_task), and of equal ids one is taken
    pieces = out.filter("__gs is not null").withColumn("__salted", F.lit(1)).withColumn("__nth", F.row_number().over(best))
    alone = out.filter("__gs is null").select("__row.*")
    return alone.unionByName(pieces.filter("__nth = 1").select("__row.*"))


def _normal(text: Column, normalise: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return normalise(text) if normalise else text


def _sorted(base: DataFrame, text: Column, keep: str, rows_per_task: int | None) -> DataFrame:
    """base (__id, ...) in the order of text, with it as __t and the group of each row within its salted piece.

    The text is taken from base's columns again after the shuffle, not sent beside them.
    """
    n = parts(base.sparkSession)
    base = base.withColumn("__h", F.xxhash64(text))
    counts = stage(base.groupBy("__h").agg(F.count("*").alias("__n")).filter("__n > 1"), "dedup-counts")
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    limit = rows_per_task or max(64, total // (4 * n))
    # at most total / limit <= 4 n rows, so this side is small by construction
    hot = counts.filter(F.col("__n") > limit).select("__h", F.ceil(F.col("__n") / limit).cast("long").alias("__k"))
    hot = stage(hot, "dedup-hot")
    drop(counts)
    salt = F.when(F.col("__k").isNotNull(), 1 + F.pmod(F.xxhash64("__id"), F.col("__k"))).otherwise(F.lit(0))
    salted = base.join(F.broadcast(hot), "__h", "left").withColumn("__salt", salt).drop("__k")
    salted = salted.withColumn("__head", F.substring(text, 1, HEAD))
    pieces = Window.partitionBy("__head", "__h", "__salt", "__t")
    order = F.col("__id").desc_nulls_last() if keep == "largest" else F.col("__id").asc_nulls_last()
    return (
        salted.repartitionByRange(n, "__head", "__h", "__salt")
        .withColumn("__t", text)
        .withColumn("__lead", _best("__id", keep).over(pieces))
        .withColumn("__size", F.count("*").over(pieces))
        .withColumn("__first", F.row_number().over(pieces.orderBy(order)) == 1)
    )


def _best(col: str, keep: str) -> Column:
    return F.max(col) if keep == "largest" else F.min(col)


def _salted_groups(rows: DataFrame, keep: str) -> DataFrame:
    """One row per salted text: as few as there are hot texts."""
    pieces = rows.filter("__salt > 0 and __first").groupBy(F.col("text_sha256").alias("__sha"))
    return pieces.agg(_best("__lead", keep).alias("__g"), F.sum("__size").alias("__gs"))


def _same_salted(rows: DataFrame) -> Column:
    return (F.col("text_sha256") == F.col("__sha")) & (F.col("__salt") > 0)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's table: no normalisation, the largest doc_id of a group stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
