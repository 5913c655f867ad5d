"""Suffix stripping for English terms, by tables of (suffix, replacement) and a measure of the stem.

Applied to distinct terms only, in Arrow batches. Terms other than a-z are lower-cased and otherwise left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The suffix tables of the published algorithm with its two later rules (bli, logi).
DOUBLE = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
SINGLE = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
BARE = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)
PLAIN = re.compile(r"[a-z]{3,}\Z")


def shape(word: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    """How many times a vowel is followed by a consonant."""
    return shape(word).count("vc")


def short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return len(word) >= 3 and shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def twin_end(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _inflection(w: str) -> str:
    if w.endswith("s"):
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            root = w[: -len(end)]
            if "v" not in shape(root):
                return w
            if root.endswith(("at", "bl", "iz")):
                return root + "e"
            if len(root) > 2 and twin_end(root):
                return root if root[-1] in "lsz" else root[:-1]
            return root + "e" if measure(root) == 1 and short_end(root) else root
    return w


def stem(term: str) -> str:
    """The stem of a term."""
    w = term.lower()
    if not PLAIN.match(w):
        return w
    w = _inflection(w)
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (dict(DOUBLE), dict(SINGLE)):
        end = _longest(w, table)
        if end and measure(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = _longest(w, BARE)
    if end:
        root = w[: -len(end)]
        if measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
            w = root
    if w.endswith("e"):
        m = measure(w)
        if m > 1 or (m == 1 and not short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("l") and twin_end(w) and len(w) > 2 and measure(w) > 1:
        w = w[:-1]
    return w


@pandas_udf(StringType())
def stem_column(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in terms:
        yield t.map(stem, na_action="ignore")
