"""Dense numbers in a sort order, and running values along posting lists, without a whole list in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, name: str, *order, first: int = 1) -> DataFrame:
    """df with a bigint column of consecutive numbers by `order`, which should leave no ties.

    Rows are range-partitioned and sorted; each partition's offset comes from the partitions' counts, of which there
    are as many as partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = F.monotonically_increasing_id()
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", mark)
    rows = rows.withColumn("__p", F.shiftright("__m", 33)).withColumn("__r", F.col("__m").bitwiseAND((1 << 33) - 1))
    rows = rows.persist()  # splitters are sampled anew by each evaluation, so there must be one
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = rows.join(F.broadcast(sizes), "__p")  # one row a partition
    return out.withColumn(name, F.col("__before") + F.col("__r") + first).drop("__m", "__p", "__r", "__before")


#: Documents in a piece of a posting list: a task sorts pieces, so the longest list is spread over many.
PIECE = 1 << 20


def pieced(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """rows (term, doc_id, ...) with piece: a range of `size` document numbers. Rows that have it are as they are, so what
    was shuffled by it isn't again.
    """
    return rows if "piece" in rows.columns else rows.withColumn("piece", F.floor(F.col("doc_id") / size).cast("long"))


def running(rows: DataFrame, name: str, value: Column, size: int = PIECE) -> DataFrame:
    """rows with the sum of value over a term's rows up to this one, in document order.

    Sums run within pieces; a term's earlier pieces, one row each, are added to them.
    """
    rows = pieced(rows, size)
    upto = Window.partitionBy("term", "piece").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("term").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("term", "piece").agg(F.sum(value).alias("own"))
    ahead = ahead.select("term", "piece", F.sum("own").over(earlier).alias("ahead")).filter("ahead is not null")
    out = rows.withColumn(name, F.sum(value).over(upto)).join(ahead, ["term", "piece"], "left")
    return out.withColumn(name, F.col(name) + F.coalesce("ahead", F.lit(0))).drop("piece", "ahead")


def before(rows: DataFrame, name: str, size: int = PIECE) -> DataFrame:
    """rows with piece and the document before this one in the term's list, null for the first."""
    rows = pieced(rows, size)
    last = rows.groupBy("term", "piece").agg(F.max("doc_id").alias("piece_last"))
    last = last.select("term", "piece", F.lag("piece_last").over(Window.partitionBy("term").orderBy("piece")).alias("piece_last"))
    out = rows.withColumn(name, F.lag("doc_id").over(Window.partitionBy("term", "piece").orderBy("doc_id")))
    out = out.join(last.filter("piece_last is not null"), ["term", "piece"], "left")
    return out.withColumn(name, F.coalesce(name, "piece_last")).drop("piece_last")
