"""Result runs: topic, document name and score, tab-separated, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def six_digits(score: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros."""
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(score))))
    text = F.when(score == 0, F.lit(0.0)).otherwise(F.round(score * scale) / scale).cast("string")
    return F.regexp_replace(text, r"\.0$", "")


def run_lines(run: DataFrame) -> DataFrame:
    """run (topic, rank, docno, score) as lines, in order."""
    line = F.concat_ws("\t", "topic", "docno", six_digits(F.col("score")))
    return run.select("topic", "rank", line.alias("line"))


def write_run(run: DataFrame, path: str) -> None:
    """One sorted text output; a run has K lines a topic."""
    lines = run_lines(run).repartitionByRange("topic", "rank").sortWithinPartitions("topic", "rank")
    lines.select("line").write.mode("overwrite").text(path)
