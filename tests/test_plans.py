"""Results on documents that share ids, have none or long words, and what plans shuffle."""

import random
import re

import duckdb
import pytest

from loomrank.operators import impact
from loomrank.operators.index import build_index
from loomrank.plans import catalog

from test_oracle import rows

COLUMNS = "doc_id long, text string, source string"


def texts(n):
    rng = random.Random(5)
    words = ["the", "thing", "que", "ther", "thon", "la", "in", "z" * 300, "z" * 301, "É" * 200, *(f"w{i}" for i in range(40))]
    odd = [None, "", " ,. ", "the", "the the THE the"]
    return odd + [" ".join(rng.choice(words[: rng.randint(1, 50)]) for _ in range(rng.randint(1, 60))) for _ in range(n - len(odd))]


def data(spark, path, ids):
    made = [(i, t, "web") for i, t in zip(ids, texts(len(ids)))]
    spark.createDataFrame(made, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return con


def same_rows(spark, con, path, name):
    df, result = catalog.queries()[name](spark, str(path)), con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    return rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())


def exchanges(df):
    """Shuffles of a plan before it runs, without those of broadcasts or of what is kept."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange (hash|range|single|round)", plan.split("InMemoryRelation")[0], re.I))


def test_odd_documents(spark, tmp_path):
    con = data(spark, tmp_path, range(300))
    for name in ("postings", "doc_lengths", "collection_stats", "term_max_score", "block_info", "doc_block_info", "score_quantize", "gap_decode"):
        assert same_rows(spark, con, tmp_path, name), name


def test_shared_ids(spark, tmp_path):
    con = data(spark, tmp_path, [i - i % 7 % 2 for i in range(300)])
    for name in ("postings", "collection_stats", "term_max_score", "doc_block_info", "score_quantize"):
        assert same_rows(spark, con, tmp_path, name), name


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts(40))], COLUMNS)
    return build_index(docs, persist=False)


def test_lengths_come_with_postings(plain):
    assert exchanges(plain.with_lengths()) == 0  # before: one for the postings, two for the join


def test_term_max_score_sends_a_row_a_term(plain):
    plan = impact.term_max_score(plain)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(term") == 1


def test_ranges_are_summed_before_the_shuffle(plain):
    plan = impact.score_quantize(impact.doc_block_info(plain, 8, 2))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "partial_max" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(term", plan)) == 2


def test_topics_need_no_other_lists(spark, tmp_path):
    keys = ("query_plan", "term_postings", "and_match", "bm25_weights", "language_model", "run_output", "block_seek")
    for name, ids, queries in (("keys", range(200), keys), ("shared", [i - i % 7 % 2 for i in range(200)], ("query_plan", "and_match", "bm25_weights"))):
        path = tmp_path / name
        con = data(spark, path, ids)
        for query in queries:
            assert same_rows(spark, con, path, query), (name, query)
        assert {key[2:] for key in catalog._indexes if key[1] == str(path)} == {(True,)}  # before: all terms were indexed


def test_block_info_shuffles_postings_once(plain):
    plan = impact.block_info(plain)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1  # of places in earlier pieces; before: of lengths and document counts too


def test_gaps_are_decoded_where_they_were_encoded(plain):
    plan = impact.gap_decode(impact.pieced_gaps(plain.postings))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(term", plan)) == 10  # before: 12
    back = impact.gap_decode(impact.pieced_gaps(plain.postings)).collect()
    assert sorted(map(tuple, back)) == sorted((r.term, r.doc_id + 1, r.tf) for r in plain.postings.collect())
