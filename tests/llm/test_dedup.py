"""Exact, near and line deduplication against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, frame, prose, words_of
from pyspark.sql import functions as F

from loomrank.llm import exact_dedup, line_dedup, minhash_dedup
from loomrank.llm.common import possible
from loomrank.llm.components import connected_components
from loomrank.llm.shingles import shingle_sets


def exact_brute(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {
        (i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    }


@pytest.mark.parametrize("keep,best,limit", [("largest", max, None), ("smallest", min, 2)])
def test_exact(spark, keep, best, limit):
    rows = awkward() + [(1000 + i, "hot copy") for i in range(40)]
    got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep, rows_per_task=limit)
    assert {tuple(r) for r in got.collect()} == exact_brute(rows, best)
    kept = exact_dedup.keep_one(frame(spark, rows), keep=keep, rows_per_task=limit)
    assert kept.columns == frame(spark, rows[:1]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x[1] for x in exact_brute(rows, best)})


def test_exact_empty_and_repeated(spark):
    docs = frame(spark, awkward()[:3])
    assert exact_dedup.exact_dedup(docs.limit(0)).isEmpty()
    twice = docs.union(docs)
    assert exact_dedup.exact_dedup(twice).count() == 6
    assert exact_dedup.keep_one(twice).count() == 2  # null and empty are equal; the blank text is another


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_shingle_sets():
    texts = [t for _, t in awkward()]
    for k in (3, 5):
        got = [len(s) for s in shingle_sets(pa.array(texts, pa.string()), k)]
        assert got == [len(shingles(t, k)) for t in texts]
        alone = [next(iter(shingle_sets(pa.array([t], pa.string()), k))) for t in texts]
        assert all(np.array_equal(a, b) for a, b in zip(alone, shingle_sets(pa.array(texts, pa.string()), k), strict=True))


@pytest.fixture(scope="module")
def family():
    """Near copies of one text at many distances, so that members of a bucket link through others only."""
    import random

    rng = random.Random(11)
    rows = awkward()
    base = prose(rng, 100).split()
    now = list(base)
    for n in range(60):
        now = list(base) if n % 20 == 0 else now
        now[rng.randrange(len(now))] = f"w{n}"
        rows.append((5000 + n, " ".join(now)))
        other = list(base)
        for _ in range(1 + n % 8):
            other[rng.randrange(len(other))] = f"v{n}"
        rows.append((6000 + n, " ".join(other)))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near(spark, monkeypatch, family, k, percent):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)  # several blocks a bucket
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_TASK", 4)
    got = minhash_dedup.near_duplicates(frame(spark, family), words=k, percent=percent).collect()
    want = near_brute(family, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_empty_null_and_keep(spark):
    docs = frame(spark, awkward())
    assert minhash_dedup.near_duplicates(docs.limit(0)).isEmpty()
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = near_brute(awkward(), 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    nulls = frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(nulls).collect()}
    assert got == {(None, None, True), (2, 2, True)}


def test_near_rows_of_one_id(spark):
    """Rows that share an id are one document, which links by any of its texts; copies of a row change nothing."""
    import random

    rng = random.Random(9)
    one, two = prose(rng, 80), prose(rng, 90)
    rows = [(7, one), (7, two), (7, two), (3, one + " more"), (9, two + " more"), (11, prose(rng, 70))]
    docs = frame(spark, rows).selectExpr("*", "'x' AS gone", "'y' AS comp")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {(7, 3, False), (3, 3, True), (9, 3, False), (11, 11, True)}
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 11}


def test_min_max_estimates():
    rng = np.random.default_rng(3)
    hasher, errors = minhash_dedup.MinMax(256), []
    for _ in range(20):
        pool = rng.integers(0, 1 << 63, 400, np.uint64)
        a, b = pool[:300], pool[100:]
        errors.append((hasher.signature(a) == hasher.signature(b)).mean() - 200 / 400)
    assert abs(np.mean(errors)) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert connected_components(df.limit(0)).isEmpty()


def shuffled(spark, job):
    """Bytes that job writes to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    job()
    return total() - before


def test_texts_shuffled(spark):
    # tables beyond the broadcast threshold: whole texts go through one shuffle in exact deduplication, and only those
    # of documents in a shared bucket in near deduplication
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.bytes(6).hex() for _ in range(6_000)) for _ in range(60)]
    texts += [texts[3], texts[7].replace(" ", " changed ", 1)]
    docs = frame(spark, list(enumerate(texts))).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = shuffled(spark, lambda: docs.repartition(4, "text").foreach(lambda r: None))
        kept = []
        exact = shuffled(spark, lambda: kept.extend(r.doc_id for r in exact_dedup.keep_one(docs).collect()))
        assert sorted(kept) == [*range(60), 61]
        kept.clear()
        near = shuffled(spark, lambda: kept.extend(r.doc_id for r in minhash_dedup.keep_one(docs).collect()))
        assert sorted(kept) == list(range(60))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert exact < 1.5 * once
    assert near < 0.6 * once


def test_lines_shuffled(spark):
    # tables beyond the broadcast threshold: of the lines' texts only those of lines with a possible partner are shuffled
    rng = np.random.default_rng(12)
    line = lambda: " ".join(rng.bytes(200).hex() for _ in range(20))
    texts = ["\n".join(line() for _ in range(10)) for _ in range(40)]
    texts.append(texts[5].split("\n")[3] + " more\n" + line())
    docs = frame(spark, list(enumerate(texts))).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = shuffled(spark, lambda: docs.repartition(4, "text").foreach(lambda r: None))
        rows = []
        moved = shuffled(spark, lambda: rows.extend(line_dedup.find_lines(docs).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 402 and [(r.doc_id, r.line_no) for r in rows if not r.kept] == [(40, 0)]
    assert moved < 0.4 * once


def test_words_of_lines(spark):
    lines = ["", " ", "a b", " a  B\tc ", "\x0b\x0c\r", "d\re f", "g\xa0h\u2028i \x00 j\x1ck\x85", "ÉÀ Σας  ΣΑΣ"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup._words(F.col("line")).alias("w"))
    assert {r.line: [w for w in r.w if w] for r in got.collect()} == {x: [w.lower() for w in words_of(x)] for x in lines}


def test_possible(spark):
    rows = spark.createDataFrame([(i, "x") for i in [*range(-500, 2_000), None, 1 << 62, -(1 << 62)]], "id long, part string")
    keys = spark.createDataFrame([(i * 10,) for i in range(-20, 150)] + [(1 << 62,)], "part long")
    got = possible(rows, F.col("id"), keys, "maybe").collect()
    assert len(got) == 2_503 and got[0].part == "x"
    held = {r.part for r in keys.collect()}
    assert all(r.maybe for r in got if r.id in held) and sum(r.maybe for r in got) < len(held) + 60
    assert not any(r.maybe for r in possible(rows, F.col("id"), keys.limit(0), "maybe").collect())


def line_brute(rows, percent=80):
    seen, out = [], {}
    for i, t in sorted(rows):
        for n, line in enumerate((t or "").split("\n")):
            s = frozenset(words_of(line.lower()))
            if s:
                out[i, n] = not any(
                    100 * len(s & x) >= percent * len(s | x) for x in seen if len(x) * 100 >= percent * len(s)
                )
                seen.append(s)
    return out


def test_lines(spark):
    import random

    rng = random.Random(8)
    rows = [r for r in awkward() if len(r[1] or "") < 50_000]
    lines = [prose(rng, n) for n in (1, 2, 3, 4, 5, 6, 9, 14, 25)]
    for n in range(40):
        own = []
        for line in lines:
            w = line.split()
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
            own.append(" ".join(w))
        rows.append((2000 + n, "\n".join(own) + "\n\n"))
    docs = frame(spark, rows)
    found = line_dedup.find_lines(docs).persist()
    assert {(r.doc_id, r.line_no): r.kept for r in found.collect()} == line_brute(rows)
    clean = {r.doc_id: r.text for r in line_dedup.clean_texts(docs, found).collect()}
    want = line_brute(rows)
    for i, t in rows:
        cut = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if want.get((i, n), True))
        assert clean[i] == cut
    assert line_dedup.find_lines(docs.limit(0)).isEmpty()


def test_line_family(spark):
    """Thousands of variants of one line and copies of another; rows that share an id, null ids, one row a document."""
    import random

    rng = random.Random(4)
    base = prose(rng, 30).split()
    rows = [(i, "one line that all of them hold, word for word\n \n" + " ".join([*base[: i % 30], f"v{i}", *base[i % 30 + 1 :]])) for i in range(5000)]
    rows += [(7, "another text\nof the same id as one above"), (None, rows[0][1]), (None, None), (9000, "")]
    got = line_dedup.line_places(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or (r.doc_id == 7 and len(r.hashes) == 2):
            assert not r.gone
        elif r.doc_id != 9000:
            assert [x >> 32 for x in r.kept] == ([0, 2] if r.doc_id == 0 else []), r
            assert [x >> 32 for x in r.gone] == ([] if r.doc_id == 0 else [0, 2]), r


def test_near_against_sql(spark, tmp_path, family):
    import duckdb
    from helpers import write_tables

    rows = [r for r in family if len(r[1] or "") < 50_000 and "\x00" not in (r[1] or "")]
    path = write_tables(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({minhash_dedup.OP1_SQL})").fetchall()
    assert {tuple(r) for r in minhash_dedup.op1_minhash_dedup(spark, path).collect()} == set(want)


def test_exact_against_sql(spark, tmp_path):
    import duckdb
    from helpers import write_tables

    rows = [r for r in awkward() if "\x00" not in (r[1] or "")]
    path = write_tables(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.OP8_SQL})").fetchall()
    assert {tuple(r) for r in exact_dedup.op8_exact_dedup(spark, path).collect()} == set(want)
