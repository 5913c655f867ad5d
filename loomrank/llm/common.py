"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.session import send_package

#: ASCII white space, as a Java and Python character class body (fixed value).
WS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a local one, in local mode only (tests)."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomrank-shared-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes an execution's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs survive lost executors.

    The shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a staged table once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the broadcast bitmap of `possible`: at most so many (8 MB), whatever the number of keys.
MOST_BITS = 1 << 26


def possible(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """df with a column `name`: true where keys (one column) may hold the key, false only where it doesn't.

    Keys set bits by their hashes in a bitmap of 16 bits a key or more, up to MOST_BITS, which is broadcast, so the rows
    that it rules out need no shuffle; an exact join of the others has to follow.
    """
    bits, n = 1 << 15, keys.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    part, bitmap = free_name(df, "part"), free_name(df, "bitmap")

    def place(c: Column) -> tuple[Column, Column]:
        h = F.xxhash64(c).bitwiseAND(bits - 1)
        return F.shiftright(h, 15), h.bitwiseAND((1 << 15) - 1)

    above, bit = place(F.col(keys.columns[0]))
    bitmaps = keys.groupBy(above.alias(part)).agg(F.bitmap_construct_agg(bit).alias(bitmap))
    above, bit = place(key)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, bit.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    out = df.join(F.broadcast(bitmaps), above == F.col(part), "left")
    return out.select(*[f"`{c}`" for c in df.columns], F.coalesce(is_set, F.lit(False)).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def whole_text(text: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The least number of common members of sets of n and m at a Jaccard similarity of percent."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def python_ready(spark: SparkSession, most: int = 8 << 20) -> None:
    """Before Python runs on executors: send them this package, and bound Arrow batches in bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    send_package(spark)
