"""The retrieval engine on micro-corpora with known values, and its invariants."""

import pytest
from pyspark.sql import functions as F

from loomrank.functions.stemmer import stem
from loomrank.operators import impact, match, rank
from loomrank.operators.index import build_index
from loomrank.sources import index_store, items, runs
from loomrank.sources.topics import parse_topics, read_topics, topic_frame, topic_of_terms

FIRST = [
    "alpha beta", "alpha alpha gamma", "beta gamma delta delta", "gamma gamma gamma", "delta epsilon",
    "alpha beta gamma", "epsilon epsilon zeta eta", "theta", "theta iota", "iota kappa kappa kappa",
]
SECOND = [
    "x y" + " f" * 28, "x x x x x", "x y" + " f" * 38, "y y y y y y", "a", "b c", "c d", "d a b", "b a", "c",
]


def corpus(spark, texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")


def found_for(spark, texts, terms):
    index = build_index(corpus(spark, texts), persist=False)
    plan = match.query_plan(topic_of_terms(spark, "T", terms), index)
    return index, plan, match.matches(plan, index)


def ids(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def first(spark):
    index, plan, found = found_for(spark, FIRST, ["alpha", "beta", "gamma"])
    return index, plan, found.persist()


@pytest.fixture(scope="module")
def second(spark):
    index, plan, found = found_for(spark, SECOND, ["x", "y"])
    return index, plan, found.persist()


def test_first_corpus(first):
    _, plan, found = first
    got = {r.doc_id: (r.tier, r.score) for r in found.collect()}
    assert got == {
        6: (1.892005, 1.877376), 1: (1.52428, 1.573319), 2: (1.129865, 1.40724), 3: (1.129865, 1.079399),
        4: (0.367725, 0.575504),
    }
    prior = {r.tier: r.prior for r in match.tier_counts(found).collect()}
    assert prior == {1.892005: 0, 1.52428: 1, 1.129865: 2, 0.367725: 4}


@pytest.mark.parametrize(
    "k,kept,returned",
    [(1, {6}, [6]), (2, {6, 1}, [6, 1]), (3, {6, 1, 2, 3}, [6, 1, 2]), (4, {6, 1, 2, 3}, [6, 1, 2, 3]), (9, {6, 1, 2, 3, 4}, [6, 1, 2, 3, 4])],
)
def test_pruning(first, k, kept, returned):
    _, _, found = first
    assert {r.doc_id for r in match.tier_prune(found, k).collect()} == kept
    assert ids(rank.bm25_tiered(found, k)) == returned
    assert rank.eval_counts(found, k).first().evaluated == len(kept)


@pytest.mark.parametrize("k,tiered,rerank,exact", [(2, [1, 3], [1, 3], [4, 2]), (3, [1, 3, 4], [4, 2, 1], [4, 2, 1])])
def test_three_rankings_differ(second, k, tiered, rerank, exact):
    _, _, found = second
    assert ids(rank.bm25_tiered(found, k)) == tiered
    assert ids(rank.bm25_rerank(found, k)) == rerank
    assert ids(rank.bm25_exact(found, k)) == exact


def test_unknown_and_empty_topics(spark, first):
    index, _, _ = first
    unknown = topic_of_terms(spark, "U", ["nowhere"])
    assert match.matches(match.query_plan(unknown, index), index).isEmpty()
    assert match.matches(match.query_plan(topic_frame(spark, []), index), index).isEmpty()
    row = match.term_lookup(unknown, index.dictionary).first()
    assert (row.term_id, row.df) == (0, 0)


def test_negative_and_zero_idf(spark):
    texts = ["z"] * 6 + ["a z", "b", "b", "b"]
    index, plan, found = found_for(spark, texts, ["z", "a"])
    assert plan.filter("term = 'z'").first().g < 0
    assert found.count() == 7
    half, plan, found = found_for(spark, ["m n"] + ["n"] * 4 + ["o"] * 5, ["m", "n"])
    assert plan.filter("term = 'n'").first().g == 0
    essential = {r.term: r.essential for r in match.essential_terms(found, plan, 1).collect()}
    assert essential["m"]


def test_essential_bound_is_safe(first):
    _, plan, found = first
    for k in (1, 2, 3, 5):
        terms = {r.term: r.essential for r in match.essential_terms(found, plan, k).collect()}
        kept_masks = match.tier_prune(found, k).select("mask").distinct().collect()
        pos = {r.term: r.pos for r in plan.collect()}
        for (mask,) in kept_masks:
            assert any(terms[t] and mask >> p & 1 for t, p in pos.items())


def test_single_term_rankings_agree(spark, first):
    index, _, _ = first
    found = match.matches(match.query_plan(topic_of_terms(spark, "G", ["gamma"]), index), index)
    assert ids(rank.bm25_tiered(found, 3)) == ids(rank.bm25_rerank(found, 3)) == ids(rank.bm25_exact(found, 3))


def test_index_sums(first):
    index, _, _ = first
    by_doc = index.postings.groupBy("doc_id").agg(F.sum("tf").alias("n")).join(index.doc_stats, "doc_id")
    assert by_doc.filter("n <> doc_len").isEmpty()
    s = index.stats.first()
    assert (s.n_docs, s.n_terms, s.total_tokens) == (10, 10, 28)
    assert s.avg_doc_len == pytest.approx(2.8)
    numbers = sorted(r.term_id for r in index.dictionary.collect())
    assert numbers == list(range(1, 11))


@pytest.mark.parametrize("df,blocks", [(64, 1), (65, 2), (128, 2)])
def test_block_boundaries(spark, df, blocks):
    index = build_index(corpus(spark, ["w"] * df + ["v v"] * 3), persist=False)
    got = impact.block_info(index).filter("term = 'w'")
    assert got.count() == blocks and got.agg(F.sum("n")).first()[0] == df
    both = impact.numbered(impact.weighted(index)).join(got.drop("n"), ["term", "block_no"])
    assert both.filter("score > max_score + 1e-12 or score < min_score - 1e-12").isEmpty()


def test_ranges_and_bytes(spark):
    index = build_index(corpus(spark, ["w"] * 1030), persist=False)
    got = impact.doc_block_info(index, 1024, 10)
    assert sorted(r.range_no for r in got.collect()) == [0, 1]
    assert spark.createDataFrame([(1023,), (1024,)], "doc_id long").select(
        F.floor((impact.doc_ord() - 1) / 1024)
    ).collect() == [(0,), (1,)]
    q = impact.score_quantize(got).join(got, ["term", "range_no"]).collect()
    assert all(r.decoded_floor <= r.max_w + 1e-9 and r.decoded_ceil >= r.max_w - 1e-9 and r.q_ceil <= 255 for r in q)


def test_gaps_round_trip(first):
    index, _, _ = first
    back = impact.gap_decode(impact.gap_encode(index.postings))
    want = {(r.term, r.doc_id + 1, r.tf) for r in index.postings.collect()}
    assert {(r.term, r.doc_ord, r.tf) for r in back.collect()} == want


def test_block_seek(spark, first):
    index = build_index(corpus(spark, ["w"] * 130), persist=False)
    blocks = impact.block_info(index)
    targets = spark.createDataFrame([("w", 1), ("w", 64), ("w", 65), ("w", 130), ("w", 131)], "term string, doc_id long")
    got = {r.doc_id: r.block_no for r in impact.block_seek(blocks, targets).collect()}
    assert got == {1: 0, 64: 0, 65: 1, 130: 2, 131: None}


def test_block_bits(spark):
    texts = ["w" if i % 2 == 0 or i > 50 else "v" for i in range(200)]
    got = impact.block_bits(build_index(corpus(spark, texts), persist=False).postings).filter("term = 'w'").collect()
    assert all(r.cut_gap < 2**r.bits and r.extra_bytes == 1 for r in got)


GOLD = (
    "caresses caress ponies poni cats cat agreed agre feed feed hopping hop falling fall filing file happy happi sky sky "
    "troubled troubl relational relat conditional condit possibly possibl archaeology archaeolog adoption adopt "
    "controlling control generalizations gener electricity electr hopefulness hope Run run is is Été été"
).split()


@pytest.mark.parametrize("word,want", list(zip(GOLD[::2], GOLD[1::2], strict=True)))
def test_stems(word, want):
    assert stem(word) == want


def test_stemmed_index(spark):
    index = build_index(corpus(spark, ["runs running", "run ran"]), stem=True, persist=False)
    assert {(r.term, r.df, r.cf) for r in index.dictionary.collect()} == {("run", 2, 3), ("ran", 1, 1)}
    topics = match.stem_topics(topic_of_terms(spark, "T", ["running", "run"]))
    assert [r.term for r in topics.orderBy("pos").collect()] == ["run", "run"]


TOPIC = "<DOC 301>\ninternational\norganized\ncrime\ncrime\n</DOC>\n<DOC 302>\npolio\trest is ignored\n</DOC>\n"


def test_topics(spark, tmp_path):
    want = [("301", 0, "international", 1), ("301", 1, "organized", 1), ("301", 2, "crime", 2), ("302", 0, "polio", 1)]
    assert parse_topics(TOPIC.split("\n")) == want
    (tmp_path / "t.txt").write_text(TOPIC)
    assert sorted(map(tuple, read_topics(spark, f"file://{tmp_path}/t.txt").collect())) == sorted(want)
    assert parse_topics(["<DOC a>", "x", "", "  \t", "<DOC b>", "y", "</DOC>", "z", "</DOC>", "<DOC c>", "lost"]) == [
        ("b", 0, "x", 1), ("b", 1, "y", 1), ("b", 0, "z", 1),
    ]


def test_stored_index_and_run(spark, first, tmp_path):
    index, plan, found = first
    path = f"file://{tmp_path}/index"
    index_store.save_index(index, path)
    index_store.save_impacts(index, path, "main")
    again = index_store.load_index(spark, path)
    assert again.stats.first() == index.stats.first()
    assert [r.doc_id for r in index_store.posting_list(again, "gamma").collect()] == [2, 3, 4, 6]
    assert index_store.doc_length(again, 3) == 4 and index_store.doc_length(again, 99) == 0
    assert index_store.doc_name(again, 3) == "3" and index_store.doc_name(again, 99) == ""
    blocks, terms = index_store.load_impacts(spark, path, "main")
    assert blocks.count() == terms.count() == 10
    best = rank.bm25_tiered(match.matches(match.query_plan(topic_of_terms(spark, "T", ["gamma"]), again), again), 2)
    run = rank.run_output(best, again.doc_names)
    runs.write_run(run, f"file://{tmp_path}/run")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/run").collect()]
    assert lines[0].split("\t")[:2] == ["T", "4"] and len(lines) == 2


def test_six_digits(spark):
    rows = spark.createDataFrame([(12345.678,), (1.5,), (0.0,), (-2.3456789,), (12.0,)], "s double")
    got = [r[0] for r in rows.select(runs.six_digits(F.col("s"))).collect()]
    assert got == ["12345.7", "1.5", "0", "-2.34568", "12"]


def test_items(spark):
    t = items.append(items.empty(spark), [b"a", b"b", b"c"])
    assert items.content(t, 0, 3) == b"abc"
    assert items.content(items.switch(t, 0, 2), 0, 3) == b"cba"
    assert items.content(items.copy(t, 0, 1, 2), 0, 3) == b"aab"
    assert items.content(items.write(t, 1, b"x"), 0, 3) == b"axc"
    assert items.content(items.delete(t, 1), 0, 3) == b"ac"
    assert items.content(items.truncate(t, 2), 0, 3) == b"ab"


def test_language_model(spark, first):
    index, plan, _ = first
    got = rank.language_model(plan, index, 3)
    assert [r.rank for r in got.orderBy("rank").collect()] == [1, 2, 3]


def test_null_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a a")], "doc_id long, text string")
    index = build_index(docs, persist=False)
    assert {r.doc_id: r.doc_len for r in index.doc_stats.collect()} == {1: 0, 2: 0, 3: 2}
    none = build_index(docs.limit(0), persist=False)
    assert none.stats.first().n_docs == 0 and none.dictionary.isEmpty()


def test_command_line(spark, tmp_path, capsys):
    from loomrank.__main__ import main

    corpus(spark, FIRST).write.parquet(f"{tmp_path}/docs")
    (tmp_path / "topics").write_text("<DOC q>\nalpha\nbeta\ngamma\n</DOC>\n")
    assert main(["build", f"{tmp_path}/docs", f"{tmp_path}/index"]) == 0
    assert main(["impacts", f"{tmp_path}/index", "main"]) == 0
    assert main(["retrieve", f"{tmp_path}/index", f"{tmp_path}/topics", f"{tmp_path}/run", "3"]) == 0
    lines = [r.value for r in spark.read.text(f"{tmp_path}/run").collect()]
    assert [x.split("\t")[1] for x in lines] == ["6", "1", "2"]
    assert "mean evaluated: 4.0" in capsys.readouterr().out
    assert main([]) == 2


def test_stems_end_to_end(spark, tmp_path):
    """A stemmed index stems its topics, also when it is stored, and from the command line."""
    from loomrank.__main__ import main

    texts = ["running runners ran", "the runner runs", "hopping hops", "relational relation", "nothing here"]
    docs = corpus(spark, texts)
    index = build_index(docs, stem=True, persist=False)
    plan = match.query_plan(topic_frame(spark, [("T", 0, "runs", 1), ("T", 1, "running", 1), ("T", 2, "hop", 1)]), index)
    assert {(r.pos, r.term) for r in plan.collect()} == {(0, "run"), (1, "run"), (2, "hop")}
    assert {r.doc_id for r in match.matches(plan, index).collect()} == {1, 2, 3}
    docs.write.parquet(f"{tmp_path}/docs")
    (tmp_path / "topics").write_text("<DOC Q>\nrelating\nhopped\n</DOC>\n")
    assert main(["build", f"{tmp_path}/docs", f"{tmp_path}/index", "stem"]) == 0
    assert index_store.load_index(spark, f"{tmp_path}/index").stemmed
    assert main(["retrieve", f"{tmp_path}/index", f"{tmp_path}/topics", f"{tmp_path}/run"]) == 0
    assert {r.value.split("\t")[1] for r in spark.read.text(f"{tmp_path}/run").collect()} >= {"3"}


def test_large_batches_of_topics_stem_alike(spark, monkeypatch):
    topics = topic_frame(spark, [("A", 0, "running", 1), ("A", 1, "runs", 2), ("B", 0, "relational", 1)])
    want = sorted(map(tuple, match.stem_topics(topics).collect()))
    monkeypatch.setattr(match, "SMALL", 1)
    assert sorted(map(tuple, match.stem_topics(topics).collect())) == want == [("A", 0, "run", 1), ("A", 1, "run", 2), ("B", 0, "relat", 1)]


def test_pieces_of_lists(spark):
    """Running values and seeks don't depend on how lists are cut."""
    from loomrank.operators import ids as numbers

    rows = spark.createDataFrame([(t, d, d % 3 + 1) for t in "ab" for d in range(0, 90, 1 if t == "a" else 7)], "term string, doc_id long, tf long")
    for size in (1, 8, 1 << 20):
        got = numbers.before(numbers.running(rows, "upto", F.col("tf"), size), "last", size)
        for t in "ab":
            total, last = 0, None
            for r in sorted((r for r in got.collect() if r.term == t), key=lambda r: r.doc_id):
                total += r.tf
                assert (r.upto, r["last"]) == (total, last)
                last = r.doc_id
    blocks = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("a", 2, 50), ("b", 0, 3)], "term string, block_no long, last_doc_id long")
    asks = [("a", d) for d in (0, 10, 11, 20, 21, 49, 50, 51)] + [("b", 3), ("b", 4), ("c", 1)]
    targets = spark.createDataFrame([(t, d, "x") for t, d in asks], "term string, doc_id long, more string")
    want = dict(zip(asks, [0, 0, 1, 1, 2, 2, 2, None, 0, None, None], strict=True))
    for size in (1, 8, 1 << 20):
        got = impact.block_seek(blocks, targets, size)
        assert got.columns == ["term", "doc_id", "more", "block_no"]
        assert {(r.term, r.doc_id): r.block_no for r in got.collect()} == want


def test_scorers(spark):
    import math

    from loomrank.functions.scoring import bm25, pivoted

    index = build_index(corpus(spark, FIRST), persist=False)
    topics = topic_frame(spark, [("T", 0, "alpha", 2)])
    g = math.log((10 - 3 + 0.5) / 3.5)
    avg = sum(len(t.split()) for t in FIRST) / 10
    for scorer, weight in (
        (bm25(k1=2.0, b=0.5), lambda tf, n: g * 3 * tf / (2 * (0.5 + 0.5 * n / avg) + tf)),
        (bm25(k3=7.0), lambda tf, n: g * 16 / 9 * 2.2 * tf / (1.2 * (0.8 + 0.2 * n / avg) + tf)),
        (pivoted(), lambda tf, n: math.log(11 / 3) * 2 * (1 + math.log(1 + math.log(tf))) / (0.8 + 0.2 * n / avg)),
    ):
        found = match.matches(match.query_plan(topics, index, scorer), index, scorer)
        got = {r.doc_id: r.score for r in found.collect()}
        assert got == pytest.approx({1: weight(1, 2), 2: weight(2, 3), 6: weight(1, 3)}, abs=1e-6)


def test_lookups_by_number_and_ranges(spark, tmp_path):
    from loomrank.sources.topics import topic_at, topic_names

    index = build_index(corpus(spark, [*FIRST, "z" * 300, "z" * 255]), persist=False)
    assert {(r.term, r.df) for r in index.dictionary.filter("length(term) > 50").collect()} == {("z" * 255, 2)}
    term = index.dictionary.filter("term_id = 2").first().term
    assert index_store.term_of(index, 2) == term and index_store.term_of(index, 999) == ""
    assert index_store.posting_list_of(index, 2).collect() == index_store.posting_list(index, term).collect()
    topics = topic_frame(spark, [("B", 0, "x", 1), ("A", 0, "y", 1)])
    assert topic_names(topics) == ["A", "B"]
    assert [r.topic for r in topic_at(topics, 1).collect()] == ["B"] and topic_at(topics, 2).isEmpty()
    index_store.save_ranges(index, str(tmp_path), "small", 4, 2)
    bounds, size, n = index_store.load_ranges(spark, str(tmp_path), "small")
    assert (size, n) == (4, 4)
    assert sorted(map(tuple, bounds.collect())) == sorted(map(tuple, impact.doc_block_info(index, 4, 2).collect()))


def test_block_seek_keeps_its_frames(spark):
    blocks = spark.createDataFrame([("a", 0, 10), ("a", 1, 20)], "term string, block_no long, last_doc_id long")
    targets = spark.createDataFrame([("a", 10), ("a", 11), ("a", 21)], "term string, doc_id long")
    got = impact.block_seek(blocks, targets, 8)
    assert {r.doc_id: r.block_no for r in got.collect()} == {10: 0, 11: 1, 21: None}
    # a frame up to the last row is computed anew for every row: quadratic in the length of a list
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
