"""Near-duplicate detection by min-max hashing, links confirmed on full shingle sets.

Signatures: each hash function of a document's shingles gives two values, the smallest and the largest, so a signature
of n values takes n / 2 evaluations of every shingle; min and max are unbiased alike and slightly negatively
correlated, so the estimate varies less. Bands of ROWS values make buckets; the number of bands follows from the
threshold so that a pair at the threshold is missed with a probability of at most MISS.

Equal sets are one node from the start. Within a bucket, members are first compared with leaders (the smallest id, then
one drawn by hash, as long as a fair part of such pairs links), each pair confirmed on full sets; connected components
follow, and only members of buckets that still hold several components are left. An exact join of those on their
shingles settles them: shingles are ordered by rarity, and two sets that reach the threshold share one of the first
n - ceil(t n) + 1 of each, at places that allow the overlap. Semi-joins by shingle keep the rows that have such a
partner in another component; their pairs are confirmed on full sets, those of groups beyond BLOCK rows in pairs of
blocks. Each candidate pair is so in one component already, or compared, or ruled out by exact bounds; no bucket is
capped, and none is spread out into all its pairs of rows.

Shingles are told apart by 64-bit hashes, equal sets by 128 bits: among a billion distinct shingles, the probability that
any two fall together is about 3 percent, and one such meeting changes an intersection by one.

Cases: null and blank texts have no shingles and link with nothing; a text with fewer words than a shingle is one
shingle of its whole sequence; texts of any length are read whole; rows that share an id are one document, which links
by any of its texts; a null id links with nothing and is kept; an empty table gives an empty result; extra columns of
any name are ignored, and in `keep_one` kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, free_name, least_overlap, parts, possible, python_ready, stage, whole_text
from .components import connected_components
from .shingles import mix, shingle_sets
from .tokenizing import slices

WORDS, THRESHOLD = 5, 80
ROWS, MISS = 6, 1e-6
#: Rounds of leaders: at most, and another one if one pair in so many has linked.
LEADER_ROUNDS, FAIR = 8, 20
BLOCK, PAIRS_PER_TASK = 256, 512
#: Hash buckets in which shingles are counted for their order.
COUNTED = 1 << 18


def n_bands(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


class MinMax:
    """Signatures of n values from n / 2 hash functions of 32 bits."""

    def __init__(self, values: int, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        half = -(-values // 2)
        self.a = (rng.integers(0, 1 << 32, half, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, half, np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """(min, max) of each function in turn; shingles: 64-bit hashes, at least one."""
        low, high = None, None
        for i in range(0, len(shingles), 2048):
            h = ((shingles[i : i + 2048] >> np.uint64(32)).astype(np.uint32) ^ self.b) * self.a
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            lo, hi = h.min(axis=1), h.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.stack([low, high], axis=1).ravel()


def _sign(words: int, rows: int, bands: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMax(rows * bands)
        number = np.arange(bands, dtype=np.uint64)
        for b in slices(batches, "text", 1 << 20):
            size, key, band = [], [], []
            for s in shingle_sets(b.column("text"), words):
                size.append(len(s))
                if not len(s):
                    key.append(None)
                    band.append(None)
                    continue
                values = hasher.signature(s)[: rows * bands]
                k = number.copy()
                for column in values.reshape(bands, rows).T.astype(np.uint64):
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + column)
                both = np.array([np.bitwise_xor.reduce(mix(s)), mix(s + np.uint64(1)).sum(dtype=np.uint64)], np.uint64)
                key.append(both.tobytes())
                band.append(k.view(np.int64))
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(key, pa.binary()),
                    pa.array(band, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "key", "bands"],
            )

    return run


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(words: int, percent: int) -> Callable:
    """Rows of (a, chunk) come together, the leader's texts (role 0) first; yields the members that link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, group = [], None
        for b in slices(batches, "text", 1 << 20):
            a, chunk, role, own = (b.column(c).to_pylist() for c in ("a", "chunk", "role", "id"))
            left, right = [], []
            for i, s in enumerate(shingle_sets(b.column("text"), words)):
                if role[i] == 0:
                    lead = [*lead, s] if group == (a[i], chunk[i]) else [s]
                    group = (a[i], chunk[i])
                    continue
                if group != (a[i], chunk[i]):
                    raise ValueError("a leader's text has to come first")
                if any(_links(x, s, percent) for x in lead):
                    left.append(a[i])
                    right.append(own[i])
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def confirm_links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. A leader a with many members is sent to several tasks."""
    n = parts(pairs.sparkSession)
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("long").alias("k"))
    chunked = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).alias("chunk"), "b")
    chunked = stage(chunked, "minhash-pairs")
    rows = chunked.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("id")).unionByName(
        chunked.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("id"))
    )
    rows = rows.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    rows = rows.repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", "role", "id")
    links = stage(rows.mapInArrow(_confirm(words, percent), "a long, b long"), "minhash-links")
    drop(chunked)
    return links


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of one list with all of another."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(common), 4096):
        part = common[i : i + 4096]
        sides = []
        for sets, flat in ((left, a), (right, b)):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            inside = part[at] == flat
            side = np.zeros((len(sets), len(part)), np.float32)
            side[np.repeat(np.arange(len(sets)), [len(x) for x in sets])[inside], at[inside]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)  # exact below 2**24


def _compare(words: int, percent: int) -> Callable:
    """Rows of a pair of blocks of a shingle come together; yields links that join components.

    Of the links found, those that join what the pair of blocks has not joined yet are enough.
    """

    def block(rows: list[tuple]) -> tuple[list, list]:
        i = [r for r in rows if r[1] == 0]
        j = [r for r in rows if r[1] == 1] or i
        if not i:
            return [], []
        id_i, n_i, c_i = (np.array([r[k] for r in i], np.int64) for k in (2, 3, 4))
        id_j, n_j, c_j = (np.array([r[k] for r in j], np.int64) for k in (2, 3, 4))
        open_ = c_i[:, None] != c_j
        open_ &= 100 * np.minimum(n_i[:, None], n_j) >= percent * np.maximum(n_i[:, None], n_j)
        if j is i:
            open_ &= id_i[:, None] < id_j
        x, y = np.nonzero(open_)
        if not len(x):
            return [], []
        ux, uy = np.unique(x), np.unique(y)
        sets = [list(shingle_sets(pa.array([side[k][5] for k in u.tolist()]), words)) for side, u in ((i, ux), (j, uy))]
        x, y = np.searchsorted(ux, x), np.searchsorted(uy, y)
        size_i, size_j = (np.array([len(k) for k in side]) for side in sets)
        both = _overlaps(*sets)[x, y]
        link = (both > 0) & (100 * both >= percent * (size_i[x] + size_j[y] - both))
        left, right, root = [], [], {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        for p, q in zip(ux[x[link]].tolist(), uy[y[link]].tolist(), strict=True):
            s, t = find(int(c_i[p])), find(int(c_j[q]))
            if s != t:
                root[max(s, t)] = min(s, t)
                left.append(int(id_i[p]))
                right.append(int(id_j[q]))
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        names = ("group", "side", "id", "n", "comp", "text")
        for b in batches:
            left, right = [], []
            for r in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if r[0] != now:
                    x, y = block(rows) if rows else ([], [])
                    left, right, now, rows = left + x, right + y, r[0], []
                rows.append(r)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        if rows:
            x, y = block(rows)
            yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def _block_pairs(rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """rows (token, id, n, comp, k) with texts, dealt as pairs of the k blocks of a shingle."""
    rows = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)))
    rows = rows.join(texts.select("id", "text"), "id")
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    rows = rows.select(
        F.xxhash64("token", lo, hi).alias("deal"),
        F.concat_ws(":", "token", lo, hi).alias("group"),
        F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"),
        "id", "n", "comp", "text",
    )
    return rows.repartition(n, "deal").drop("deal").sortWithinPartitions("group", "side", "id")


def _count_shingles(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for b in slices(batches, "text", 1 << 20):
            for s in shingle_sets(b.column("text"), words):
                np.add.at(total, (s & np.uint64(COUNTED - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def _prefixes(words: int, percent: int, classes: np.ndarray) -> Callable:
    """Each set's size and its rarest shingles, as many as one of has to be shared, in the order of rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            size, rare = [], []
            for s in shingle_sets(b.column("text"), words):
                n = len(s)
                order = np.lexsort((s, classes[(s & np.uint64(COUNTED - 1)).astype(np.int64)]))
                size.append(n)
                rare.append(s[order[: n + (-percent * n // 100) + 1]].view(np.int64))
            yield pa.record_batch(
                [b.column("id"), b.column("comp"), pa.array(size, pa.int64()), pa.array(rare, pa.list_(pa.int64()))],
                ["id", "comp", "n", "prefix"],
            )

    return run


def _links_left(left: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of different components among left (id, comp), by an exact join of their sets."""
    n = parts(left.sparkSession)
    texts = stage(found.withColumnRenamed("doc_id", "id").join(left, "id").select("id", "comp", "text"), "minhash-left")
    counts = texts.select("text").mapInArrow(_count_shingles(words), "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    classes = np.zeros(COUNTED, np.uint8)
    for bucket, c in counts.collect():  # at most COUNTED rows
        classes[bucket] = min(255, int(8 * math.log2(c + 1)))
    prefix = texts.mapInArrow(_prefixes(words, percent, classes), "id long, comp long, n long, prefix array<long>")
    every = stage(prefix.select("id", "comp", "n", F.posexplode("prefix").alias("p", "token")), "minhash-prefix")
    # shingles that several components hold, with the one of most rows
    held = every.groupBy("token", "comp").agg(F.count("*").alias("c"))
    held = held.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    rows = stage(every.join(held.select("token", F.col("top.comp").alias("main")), "token"), "minhash-shared")
    size, other, at, there = (F.col(c) for c in ("a.n", "b.n", "a.p", "b.p"))
    meet = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.comp") != F.col("b.comp"))
        & (F.least(size - at, other - there) >= least_overlap(size, other, percent))
    )
    # one side is outside the main component, so rows of that one aren't held against each other
    minor = rows.filter("comp <> main")
    asked = minor.alias("a").join(rows.alias("b"), meet, "left_semi")
    asking = rows.filter("comp = main").alias("a").join(minor.alias("b"), meet, "left_semi")
    near = stage(asked.unionByName(asking).select("token", "id", "comp", "n", "p"), "minhash-near")
    blocks = near.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    few = stage(near.join(blocks, "token"), "minhash-blocks")
    small = few.filter("k = 1")  # so a row meets fewer than BLOCK others
    pairs = small.alias("a").join(small.alias("b"), meet & (F.col("a.id") < F.col("b.id")))
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    links = confirm_links(pairs, found, words, percent)
    large = _block_pairs(few.filter("k > 1").select("token", "id", "n", "comp", "k").distinct(), texts, n)
    more = stage(large.mapInArrow(_compare(words, percent), "a long, b long"), "minhash-links")
    for spent in (texts, every, rows, near, few):
        drop(spent)
    return links.unionByName(more)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = THRESHOLD,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= percent * union of their sets of shingles of `words` words. A component's
    id is the smallest document id in it; the document of that id is kept. Ids are integers.
    """
    spark = docs.sparkSession
    python_ready(spark)
    n, bands = parts(spark), n_bands(percent, rows, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    signed = stage(
        texts.mapInArrow(
            _sign(words, rows, bands), "doc_id long, n_shingles long, key binary, bands array<long>"
        ),
        "minhash-signed",
    )
    # equal sets: one node, their smallest id
    node = (
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("key", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    )
    node = stage(node, "minhash-nodes")
    buckets = node.select(F.explode("bands").alias("bucket"), "id", F.col("n_shingles").alias("n"))
    shared = buckets.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("c"))
    shared = shared.filter("c > 1").select("bucket", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n"))
    members = stage(buckets.join(shared, "bucket"), "minhash-members")
    involved = stage(members.select(F.col("id").alias("doc_id")).distinct(), "minhash-involved")
    # of the texts only those that may be involved are shuffled
    near = possible(texts, F.col("doc_id"), involved, "near").filter("near").drop("near")
    found = stage(near.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "minhash-texts")

    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pairs = members.filter((F.col("id") != F.col("lead")) & fits(F.col("n"), F.col("lead_n")))
    pairs = pairs.select(F.col("lead").alias("a"), F.col("id").alias("b"))
    links = None
    spent = [signed, node, members, involved, found]
    for turn in range(1, LEADER_ROUNDS + 1):
        pairs = stage(pairs.distinct(), "minhash-pairs")
        new = confirm_links(pairs, found, words, percent)
        links = new if links is None else links.unionByName(new)
        comp = _components(links)
        placed = members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")).select("bucket", "id", "n", "comp")
        state = placed.groupBy("bucket").agg(
            F.min("comp").alias("c0"),
            F.max("comp").alias("c1"),
            F.count("*").alias("c"),
            F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "comp")).alias("lead"),
        )
        # two members whose pair was compared in the first turn are done
        state = state.filter("c0 <> c1 and c > 2").drop("c0", "c1", "c")
        mixed = stage(placed.join(state, "bucket"), "minhash-mixed")
        spent += [pairs, mixed, comp]
        if mixed.isEmpty():
            break
        if turn == LEADER_ROUNDS or new.count() * FAIR < pairs.count():
            left = mixed.groupBy("id").agg(F.min("comp").alias("comp"))
            links = links.unionByName(_links_left(left, found, words, percent))
            comp = _components(links)
            spent.append(comp)
            break
        pairs = mixed.filter((F.col("comp") != F.col("lead.comp")) & fits(F.col("n"), F.col("lead.n")))
        pairs = pairs.select(F.col("lead.id").alias("a"), F.col("id").alias("b"))

    keyed = node.select("key", "n_shingles", "id").join(comp, "id", "left")
    keyed = keyed.select("key", "n_shingles", F.coalesce("comp", "id").alias("comp"))
    out = signed.select("doc_id", "n_shingles", "key").join(keyed, ["key", "n_shingles"], "left")
    out = out.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"),
    )
    out = stage(out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))), "minhash-result")
    for table in (*spent, links):
        drop(table)
    return out


def _components(links: DataFrame) -> DataFrame:
    """(id, comp) of every linked document."""
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.select(F.col("node").alias("id"), F.col("component").alias("comp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that stay, with all their columns: one document of each component.

    Only rows that may be gone are shuffled, those that a bitmap of the gone ids doesn't rule out.
    """
    name, flag = free_name(docs, "gone"), free_name(docs, "maybe")
    gone = near_duplicates(docs, id_col, text_col, **kw).filter("not kept").select(F.col(id_col).alias(name)).distinct()
    marked = possible(docs, F.col(id_col).cast("long"), gone, flag)
    rest = marked.filter(F.col(flag)).join(gone, F.col(id_col) == F.col(name), "left_anti")
    return marked.filter(~F.col(flag)).union(rest).drop(flag)


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, percent=85)


#: The same by SQL, on sets of words themselves: intersections counted by shingle, components by reachability.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM w),
g AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM s GROUP BY s),
t AS (SELECT id, n, unnest(s) AS x FROM g),
e AS (SELECT a.id AS u, b.id AS v FROM t a JOIN t b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n
      HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(id, v) AS (SELECT id, id FROM g WHERE n > 0 UNION SELECT r.id, ways.v FROM r JOIN ways ON r.v = ways.u),
c AS (SELECT id, min(v) AS comp FROM r GROUP BY id)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(comp, doc_id) AS component_id, coalesce(comp, doc_id) = doc_id AS kept
FROM s JOIN g USING (s) LEFT JOIN c USING (id)
"""
