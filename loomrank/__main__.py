"""python -m loomrank build DOCUMENTS INDEX [stem] | impacts INDEX NAME | ranges INDEX NAME [SIZE LEAST_DF] | retrieve INDEX TOPICS RUN [K] [tiered|rerank|exact]

Runs in the session that spark-submit gives, or a local one.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomrank.operators import match, rank
from loomrank.operators.index import build_index
from loomrank.sources import index_store, runs
from loomrank.sources.topics import read_topics

K = 1000
RANKINGS = {"tiered": rank.bm25_tiered, "rerank": rank.bm25_rerank, "exact": rank.bm25_exact}


def retrieve(spark: SparkSession, index_path: str, topics_path: str, run_path: str, k: int = K, how: str = "tiered") -> None:
    """Writes the run; prints documents evaluated by topic and their mean, and the seconds of the batch."""
    index = index_store.load_index(spark, index_path)
    began = time.perf_counter()
    found = match.matches(match.query_plan(read_topics(spark, topics_path), index), index).persist()
    runs.write_run(rank.run_output(RANKINGS[how](found, k), index.doc_names), run_path)
    took = time.perf_counter() - began
    counts = rank.eval_counts(found, k)
    counts.orderBy("topic").show(truncate=False)
    mean = counts.agg(F.avg("evaluated")).first()[0]
    print(f"mean evaluated: {mean or 0:.1f}; seconds: {took:.3f}")
    found.unpersist()


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("build", "impacts", "ranges", "retrieve"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("loomrank").getOrCreate()
    if args[0] == "build":
        index_store.save_index(build_index(spark.read.parquet(args[1]), stem="stem" in args[3:]), args[2])
    elif args[0] == "impacts":
        index_store.save_impacts(index_store.load_index(spark, args[1]), args[1], args[2])
    elif args[0] == "ranges":
        index_store.save_ranges(index_store.load_index(spark, args[1]), args[1], args[2], *[int(x) for x in args[3:5]])
    else:
        retrieve(spark, *args[1:4], *[int(x) for x in args[4:5]], *args[5:6])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
