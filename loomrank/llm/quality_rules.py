"""Quality rules: statistics of a text, fixed base rules, and a learned decision list, in DataFrame functions only.

The decision list is learned by sequential covering. Each round grows one conjunction of thresholds on two thirds of
the labelled rows (by FOIL's information gain), prunes conditions from its end on the other third while that doesn't
lower (p - n) / (p + n), and drops the rows it covers; a rule that isn't precise on the rows set aside is dropped, and
the next one begins with another feature. The learner reads a sample of the labelled rows, chosen by a hash of the id:
all rows of a label of which there are at most `per_class`, else about `per_class` of them, weighted by what they stand
for. Their features come to the driver once, as a table of thresholds reached, and covering counts in that table. The
rules leave as one ordered conditional expression, which decides on every document.

Cases: a null or blank text has no words, so all statistics are 0 and it fails the base rules; texts of any length are
read whole; labels of unknown documents, null labels and labels that contradict each other for one document are
left out, repeated equal ones count once; without labelled rows of both kinds the list is empty and keeps everything;
an empty table gives an empty result; extra columns of any name are ignored, and in `apply_rules` kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, drop, free_name, let, stage, whole_text

WINDOW = 8
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: About how many labelled rows of a label the learner reads at most.
PER_CLASS = 20_000

#: The learner's features: ratios of the statistics, so that no rule depends on a text's length alone.
FEATURES = {
    "symbol_ratio": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "exclaim_ratio": lambda c: c("n_exclaims") / F.greatest(c("n_words"), F.lit(1)),
    "upper_ratio": lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
    "word_length": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "distinct_ratio": lambda c: c("n_distinct") / F.greatest(c("n_words"), F.lit(1)),
    "repeat_ratio": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "dup_line_ratio": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "digit_ratio": lambda c: c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
}


def _count(text: Column, keep: str) -> Column:
    """How many characters of a class a text has; keep: the class's complement, as a pattern."""
    return F.length(F.regexp_replace(text, keep, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text holds twice or more."""

    def covered(at: Column) -> Column:  # at: starts of such windows, ascending
        gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def starts(found: Column) -> Column:  # found: (window, start), sorted
        same = F.filter(
            found,
            lambda x, i: (F.get(found, i - 1)["g"] == x["g"]) | (F.get(found, i + 1)["g"] == x["g"]),
        )
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - WINDOW + 1
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def repeated(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(
            let(let(pairs, starts), covered)
        )

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(windows(words), repeated)).cast("long")


def text_stats(text: Column) -> list[Column]:
    """The statistics of a text as columns; windows of words are told apart by 64-bit hashes within one text."""
    # not $, which also matches before a final line separator
    bare = F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WS}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    by_word = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return [
        by_word.alias("words"),
        by_line.alias("lines"),
        _count(text, f"[{WS}]+").alias("word_chars"),
        _count(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        _count(text, r"[^!]+").alias("n_exclaims"),
        _count(text, r"\P{Lu}+").alias("n_upper"),
        _count(text, r"[^0-9]+").alias("n_digits"),
    ]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_distinct", "n_lines", "n_exclaims", "n_upper", "n_digits")


def with_stats(docs: DataFrame, into: str, text_col: str = "text") -> DataFrame:
    """docs with one struct column of the statistics, `into`, a name that docs doesn't have."""
    stats = F.col(into)
    flat = F.struct(
        *[stats["words"][c].alias(c) for c in ("n_words", "n_distinct", "n_repeat_words")],
        *[stats["lines"][c].alias(c) for c in ("n_lines", "n_dup_lines")],
        *[stats[c].alias(c) for c in ("word_chars", "n_symbols", "n_exclaims", "n_upper", "n_digits")],
    )
    return docs.withColumn(into, F.struct(*text_stats(whole_text(text_col)))).withColumn(into, flat)


def base_failed(c) -> Column:
    """The base rules over statistics; c: name to column."""
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


@dataclass
class Rule:
    """If all conditions (feature, ">=" or "<", threshold) hold, the document is rejected."""

    conditions: list[tuple[str, str, float]]
    rejected: int = 0
    wrong: int = 0

    def column(self, c) -> Column:
        out = F.lit(True)
        for name, op, t in self.conditions:
            value = FEATURES[name](c)
            out = out & ((value >= t) if op == ">=" else (value < t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {t:.4g}" for n, op, t in self.conditions) + f" -> reject ({self.rejected}/{self.wrong})"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def keep(self, c) -> Column:
        """The ordered conditional expression: the first rule that holds decides, else the document is kept."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(c), False) if out is None else out.when(rule.column(c), False)
        return F.lit(True) if out is None else out.otherwise(True)


def learn(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    stats_col: str = "stats",
    label_col: str = "quality",
    per_class: int = PER_CLASS,
    **settings,
) -> DecisionList:
    """A decision list that rejects documents of label 0.

    stats: ids and the struct column of statistics. Documents that pass the base rules teach, about per_class of a label.
    settings: those of `cover`.
    """
    one = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
        .filter("i is not null and y in (0, 1)")
        .groupBy("i")
        .agg(F.min("y").alias("y"), F.max("y").alias("y1"))
        .filter("y = y1")
        .drop("y1")
    )
    c = lambda name: F.col("s")[name]
    known = stats.select(F.col(id_col).alias("i"), F.col(stats_col).alias("s")).join(one, "i").filter(~base_failed(c))
    known = stage(
        known.select("y", F.xxhash64("i").alias("h"), *[FEATURES[n](c).cast("double").alias(n) for n in FEATURES]),
        "rules-known",
    )
    counts = dict(known.groupBy("y").count().collect())  # two rows
    if len(counts) < 2:
        drop(known)
        return DecisionList()
    # a hash below a bound: the same rows in every run, and no task gathers them
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}
    chosen = F.lit(False)
    for y, part in share.items():
        bound = F.lit(int(part * 2**32))
        chosen = chosen | ((F.col("y") == y) & (F.shiftrightunsigned("h", 32) < bound))
    rows = known.filter(chosen).collect()  # about per_class a label at most
    drop(known)
    y = np.array([r[0] for r in rows], np.int64)
    weight = np.where(y == 0, counts[0], counts[1]) / np.maximum(np.where(y == 0, (y == 0).sum(), (y == 1).sum()), 1)
    aside = np.array([r[1] % 3 == 0 for r in rows], bool)
    return cover(np.array([r[2:] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), y, weight, aside, **settings)


def thresholds(values: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """The cuts of a feature: its quantiles over all rows, and over each label's, as one label may be rare."""
    at = np.arange(1, bins) / bins
    sets = [v for v in (values, values[y == 0], values[y == 1]) if len(v)]
    return np.unique(np.concatenate([np.quantile(v, at, method="inverted_cdf") for v in sets])) if sets else np.zeros(0)


def cover(
    values: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    aside: np.ndarray,
    bins: int = 64,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.95,
    min_rows: int = 5,
) -> DecisionList:
    """Sequential covering over a table: values by (row, feature), labels, weights, and which rows are set aside for
    pruning. Ties go to the more covered, then the earlier feature, the lower threshold, ">="."""
    names = list(FEATURES)
    edges = [thresholds(values[:, f], y, bins) for f in range(len(names))]
    binned = np.stack([np.searchsorted(e, values[:, f], "right") for f, e in enumerate(edges)], axis=1)
    bad, good = np.where(y == 0, weight, 0.0), np.where(y == 1, weight, 0.0)
    left = np.ones(len(y), bool)
    rules: list[Rule] = []
    failed: set[int] = set()  # features that began a rule which didn't hold on the rows set aside
    while len(rules) < max_rules:
        grown = _grow(binned, bad, good, left & ~aside, edges, max_conditions, min_rows, failed)
        if not grown:
            break
        kept, p, n = _prune(binned, bad, good, left & aside, grown)
        if p + n == 0 or p < min_precision * (p + n):
            failed.add(grown[0][0])
            continue
        failed = set()
        held = left & _holds(binned, kept)
        conditions = [(names[f], op, float(edges[f][b - 1])) for f, op, b in kept]
        rules.append(Rule(conditions, round(bad[held].sum()), round(good[held].sum())))
        left &= ~held
    return DecisionList(rules)


def _holds(binned: np.ndarray, conditions: list[tuple[int, str, int]]) -> np.ndarray:
    out = np.ones(len(binned), bool)
    for f, op, b in conditions:
        out &= (binned[:, f] >= b) if op == ">=" else (binned[:, f] < b)
    return out


def _grow(
    binned: np.ndarray, bad: np.ndarray, good: np.ndarray, rows: np.ndarray, edges: list, most: int, min_rows: int, failed: set
) -> list[tuple[int, str, int]]:
    """Adds the condition of most information gain until none of label 1 is covered or none gains; failed: features
    that don't begin a rule."""
    chosen: list[tuple[int, str, int]] = []
    for _ in range(most):
        now = np.flatnonzero(rows & _holds(binned, chosen))
        P, N = bad[now].sum(), good[now].sum()
        if not P or not N:
            break
        best = None
        for f, cuts in enumerate(edges):
            if not chosen and f in failed:
                continue
            cells = binned[now, f]
            # of the rows at a threshold or above: weights, and how many of label 0
            above = [
                np.cumsum(np.bincount(cells, x, len(cuts) + 1)[::-1])[::-1][1:]
                for x in (bad[now], good[now], (bad[now] > 0).astype(float))
            ]
            count = (bad[now] > 0).sum()
            for op, (p, n, k) in ((">=", above), ("<", [P - above[0], N - above[1], count - above[2]])):
                ok = (k >= min_rows) & (p + n < (P + N) * (1 - 1e-12))
                gain = np.full(len(cuts), -np.inf)
                gain[ok] = p[ok] * (np.log2(p[ok] / (p[ok] + n[ok])) - np.log2(P / (P + N)))
                for b in np.flatnonzero(gain > 1e-9):
                    key = (round(gain[b], 9), round(p[b], 9), -f, -b, op)
                    if best is None or key > best[0]:
                        best = (key, (f, op, int(b) + 1), n[b])
        if best is None:
            break
        chosen.append(best[1])
        if best[2] <= 1e-9:
            break
    return chosen


def _prune(binned: np.ndarray, bad: np.ndarray, good: np.ndarray, rows: np.ndarray, grown: list) -> tuple[list, float, float]:
    """Drops final conditions while (p - n) / (p + n) doesn't fall on rows that didn't grow the rule."""
    best, value = (grown, 0.0, 0.0), -2.0
    for k in range(len(grown), 0, -1):
        held = rows & _holds(binned, grown[:k])
        p, n = bad[held].sum(), good[held].sum()
        now = (p - n) / (p + n) if p + n else -1.0
        if now >= value:
            best, value = (grown[:k], p, n), now
    return best


def _named(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **settings
) -> tuple[DataFrame, DecisionList]:
    """(id, base statistics, base_failed, kept, further statistics) of every document, and the list that was learned."""
    stats = with_stats(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "s", "t").select("i", "s")
    stats = stage(stats, "rules-stats")
    rules = learn(stats, _named(labels, id_col, label_col), "i", "s", "y", **settings)
    c = lambda name: F.col("s")[name]
    failed = base_failed(c)
    out = stats.select(
        F.col("i").alias(id_col),
        *[c(n).alias(n) for n in COUNTS],
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(rules.keep(c)).alias("kept"),
        *[c(n).alias(n) for n in MORE_COUNTS],
    )
    return out, rules


def apply_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **settings
) -> DataFrame:
    """The rows of docs that pass, with their own columns only. Rows and statistics are written once, then read twice."""
    name = free_name(docs, "stats")
    rows = stage(with_stats(docs, name, text_col), "rules-rows")
    known = rows.select(F.col(id_col).alias("i"), F.col(name).alias("s"))
    rules = learn(known, _named(labels, id_col, label_col), "i", "s", "y", **settings)
    c = lambda x: F.col(name)[x]
    return rows.filter(F.when(base_failed(c), False).otherwise(rules.keep(c))).drop(name)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels)[0]
