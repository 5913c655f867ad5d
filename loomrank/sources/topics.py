"""Topics: the tagged text format, argument lists, and the topics table (topic, pos, term, qtf)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "topic string, pos int, term string, qtf long"


def _rows(topic: str, counts: dict[str, int]) -> list[tuple]:
    return [(topic, i, term, n) for i, (term, n) in enumerate(counts.items())]


def parse_topics(lines: Iterable[str]) -> list[tuple[str, int, str, int]]:
    """Rows of the topics table from lines of the tagged format.

    "<DOC id>" names the topic, one term a line (up to a space or tab) adds to it, "</DOC>" ends it; the name holds
    until it is changed, and terms before the end tag belong to the topic that ends. What no end tag follows is left
    out, and so are blank lines.
    """
    topic, counts, out = "", {}, []
    for raw in lines:
        line = raw.rstrip("\n")
        if line.startswith("<DOC "):
            topic = line[5:].split(">", 1)[0]
        elif "</DOC>" in line:
            out += _rows(topic, counts)
            counts = {}
        else:
            token = line.lstrip(" \t").replace("\t", " ").split(" ", 1)[0]
            if token:
                counts[token] = counts.get(token, 0) + 1
    return out


def topic_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """A topic file by any path Spark can open. Topic files are a few terms a query, so they pass the driver."""
    whole = spark.read.text(path, wholetext=True).collect()
    return topic_frame(spark, [r for f in whole for r in parse_topics(f.value.split("\n"))])


def topic_of_terms(spark: SparkSession, topic: str, terms: Iterable[str]) -> DataFrame:
    """One topic from separate terms, equal ones counted."""
    counts: dict[str, int] = {}
    for t in terms:
        counts[t] = counts.get(t, 0) + 1
    return topic_frame(spark, _rows(topic, counts))


def topic_names(topics: DataFrame) -> list[str]:
    """The topics' names in order; as many as there are topics."""
    return [r.topic for r in topics.select("topic").distinct().orderBy("topic").collect()]


def topic_at(topics: DataFrame, number: int) -> DataFrame:
    """The terms of a topic by its place (from 0) among the names in order; none beyond the last."""
    names = topic_names(topics)
    return topics.filter(F.col("topic") == names[number]) if 0 <= number < len(names) else topics.limit(0)
