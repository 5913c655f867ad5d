"""A store of items by number as a table (item_no, content): a value is a table, each operation gives another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "item_no long, content binary"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def append(items: DataFrame, contents: list[bytes]) -> DataFrame:
    """With new items after the last; contents are those of one call, so few."""
    last = items.agg(F.coalesce(F.max("item_no"), F.lit(-1))).first()[0]
    return items.unionByName(items.sparkSession.createDataFrame([(last + 1 + i, c) for i, c in enumerate(contents)], SCHEMA))


def read(items: DataFrame, first: int, count: int = 1) -> DataFrame:
    return items.filter(F.col("item_no").between(first, first + count - 1)).orderBy("item_no")


def content(items: DataFrame, first: int, count: int = 1) -> bytes:
    return b"".join(r.content for r in read(items, first, count).collect())


def write(items: DataFrame, item_no: int, value: bytes) -> DataFrame:
    return items.withColumn("content", F.when(F.col("item_no") == item_no, F.lit(value)).otherwise(F.col("content")))


def delete(items: DataFrame, item_no: int) -> DataFrame:
    """The item's content goes, its number stays."""
    return write(items, item_no, b"")


def truncate(items: DataFrame, count: int) -> DataFrame:
    return items.filter(F.col("item_no") < count)


def copy(items: DataFrame, source: int, target: int, count: int = 1) -> DataFrame:
    """Items from source on also at target on; what was there is replaced."""
    moved = read(items, source, count).withColumn("item_no", F.col("item_no") + (target - source))
    return items.join(moved.select("item_no"), "item_no", "left_anti").unionByName(moved)


def switch(items: DataFrame, a: int, b: int) -> DataFrame:
    n = F.col("item_no")
    return items.withColumn("item_no", F.when(n == a, b).when(n == b, a).otherwise(n).cast("long"))
