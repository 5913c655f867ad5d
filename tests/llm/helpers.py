"""Fixtures of the operator tests: small corpora with the awkward cases in them."""

from __future__ import annotations

import random
import re

WORDS = [f"{a}{b}" for a in ("al", "be", "cor", "dun", "er", "fi", "gor", "hu") for b in ("ta", "mi", "ro", "sen", "lo")]
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return SPACES.findall(text or "")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): null, empty, blank, one word, very long, copies, near copies, unusual characters."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.replace(base.split()[40], "changed", 1)
    long_text = prose(rng, 30_000)
    texts = [None, "", "  \n\t ", "word", "two words", "two words", base, base, near, long_text, "Straße ÉCOLE 日本語 😀", "a\x00b c"]
    texts += [prose(rng, rng.randint(5, 90)) + "\n" + prose(rng, 12) for _ in range(30)]
    texts += [texts[-1], base + "\nlast line of it"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 7) for i, t in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, id int"
    ).repartition(5)


def write_tables(spark, folder, rows, labels=()):
    """A data directory with documents and labels; returns its path."""
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(
        f"{folder}/labels.parquet"
    )
    return str(folder)
