"""Scoring expressions. Collection values are columns or numbers, so one definition serves every plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.2


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)); zero or negative for terms in half of all documents or more."""
    return F.log((n_docs - df + 0.5) / (df + 0.5))


def tf_weight(tf: Column, doc_len: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    """BM25's saturated and length-normalised term frequency."""
    return (k1 + 1) * tf / (k1 * ((1 - b) + b * doc_len / avg_len) + tf)


# Opt-in alternatives; no ranking uses them unless asked to.


def qtf_weight(qtf: Column, k3: float = 7.0) -> Column:
    """Saturation of repeated query terms."""
    return (k3 + 1) * qtf / (k3 + qtf)


def idf_plain(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / df)


def tf_pivoted(tf: Column, doc_len: Column, avg_len: Column, b: float = B) -> Column:
    return (1 + F.log(1 + F.log(tf))) / ((1 - b) + b * doc_len / avg_len)


def dirichlet(tf: Column, doc_len: Column, cf: Column, total: Column, mu: float = 2500.0) -> Column:
    """Log-probability of a term under a Dirichlet-smoothed model; tf 0 for a term that doesn't occur."""
    return F.log((tf + mu * cf / total) / (doc_len + mu))


@dataclass(frozen=True)
class Scorer:
    """A ranking function: a term's weight from (n_docs, df, qtf) times a posting's from (tf, doc_len, avg_len)."""

    term: Callable[[Column, Column, Column], Column]
    posting: Callable[[Column, Column, Column], Column]


def bm25(k1: float = K1, b: float = B, k3: float | None = None) -> Scorer:
    """BM25; k3: repeated query terms count more, with saturation."""
    return Scorer(
        lambda n, df, qtf: idf(n, df) if k3 is None else idf(n, df) * qtf_weight(qtf, k3),
        lambda tf, length, avg: tf_weight(tf, length, avg, k1, b),
    )


def pivoted(b: float = B) -> Scorer:
    """Pivoted length normalisation with plain idf and query term counts."""
    return Scorer(lambda n, df, qtf: idf_plain(n, df) * qtf, lambda tf, length, avg: tf_pivoted(tf, length, avg, b))


BM25 = bm25()
