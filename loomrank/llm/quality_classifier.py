"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded (statistics of its characters and words, then
a learned layer), a gated attention learns from document labels how much each passage weighs, and the weighted sum is
scored. Training is by Adam on the driver over a bounded sample; scoring is a map over all texts, whole.

The bound of the fit is a parameter: `per_class` labelled documents of each label (those whose ids hash smallest), each
with all its passages. The sample is small by construction, so it is broadcast to pick the training texts. Nothing of
scoring is bounded.

Cases: a null, empty or blank text is one passage of zeros; texts of any length are scored whole; labels that are null
or contradict each other for a document are left out, repeated ones count once; without labelled rows of both kinds
every score is the share of label 1 (or 0.5 without any); repeated rows get equal scores; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, whole_text
from .shingles import lowered, raw_bytes, word_hashes
from .tokenizing import slices

PASSAGE, PER_CLASS = 128, 1500
#: Classes of bytes: a-z, A-Z, 0-9, white space, symbols, sentence marks, other ASCII, beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
FEATURES = 64 + 5


def passage_features(texts: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(a row of features for each passage, the number of passages of each text); every text has one at least."""
    data, bounds = raw_bytes(texts)
    hashes, places = word_hashes(lowered(data), bounds)
    words = np.diff(np.searchsorted(places, bounds))
    per = np.maximum(1, -(-words // size))
    total = int(per.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(hashes):
        return out, per
    first = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(words)), words)
    nth = np.arange(len(hashes)) - np.repeat(np.cumsum(words) - words, words)
    passage = first[text] + nth // size
    # bytes: those from a passage's first word to the next passage or the end of the text
    begins = np.flatnonzero(nth % size == 0)
    mark = np.zeros(len(data), np.int64)
    mark[places[begins]] = 1
    of = passage[begins][np.maximum(np.cumsum(mark) - 1, 0)]
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    kind = _CLASS[data]
    after = np.append(kind[1:], 3)
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    after[ends] = 3
    own = (of >= first[owner]) & (of < first[owner + 1]) & (np.cumsum(mark) > 0)
    pairs = np.bincount(of[own] * 64 + kind[own] * 8 + after[own], minlength=total * 64).reshape(total, 64)
    n = np.bincount(passage, minlength=total).astype(np.float64)
    some = np.maximum(n, 1)
    out[:, :64] = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    order = np.lexsort((hashes, passage))
    h, p = hashes[order], passage[order]
    new = np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]))
    out[:, 64] = np.bincount(p[new], minlength=total) / some
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1]))
    out[:, 65] = np.bincount(passage[same], minlength=total) / some
    out[:, 66] = np.log1p(n) / 5
    out[:, 67] = pairs[:, :].sum(axis=1) / some / 10
    # how alike the words of a passage are: share of its most repeated word
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(h)))
    most = np.zeros(total)
    np.maximum.at(most, p[starts], runs)
    out[:, 68] = most / some
    return out, per


@dataclass
class Model:
    """Parameters by name; mean and scale standardise features; prior: the score when nothing was learned."""

    p: dict[str, np.ndarray] | None
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def forward(self, x: np.ndarray, per: np.ndarray) -> dict:
        p = self.p
        at = np.concatenate([[0], np.cumsum(per)[:-1]])
        bag = np.repeat(np.arange(len(per)), per)
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, s = np.tanh(h @ p["V"] + p["v"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "bag": bag, "at": at}

    def scores(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(per), self.prior)
        return self.forward(((x - self.mean) / self.scale).astype(np.float64), per)["y"]


def _gradient(model: Model, x: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    p, f = model.p, model.forward(x, per)
    ds = weight * (f["y"] - y) / len(y)
    dz = ds[:, None] * p["c"]
    da = (dz[f["bag"]] * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[f["bag"]])
    dg = de[:, None] * p["w"]
    dt, du = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + du @ p["U"].T
    dh[f["h"] <= 0] = 0
    return {
        "W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "v": dt.sum(axis=0), "U": f["h"].T @ du,
        "u": du.sum(axis=0), "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ ds, "d": np.array(ds.sum()),
    }


def train(
    bags: list[np.ndarray], labels: np.ndarray, share: float, hidden: int = 32, gate: int = 16, epochs: int = 25, seed: int = 7
) -> Model:
    """share: of label 1 among all labelled documents, to which the two classes are weighted."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(bags).astype(np.float64)
    model = Model(None, flat.mean(axis=0), flat.std(axis=0) + 1e-3, share)
    if len(set(labels.tolist())) < 2:
        return model
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model.p = {
        "W": draw(FEATURES, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "v": np.zeros(gate),
        "U": draw(hidden, gate), "u": np.zeros(gate), "w": draw(gate), "c": draw(hidden), "d": np.array(0.0),
    }
    of_one = labels.mean()
    weight = np.where(labels == 1, share / of_one, (1 - share) / (1 - of_one))
    bags = [(b - model.mean) / model.scale for b in bags]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            take = order[i : i + 64]
            x, per = np.concatenate([bags[k] for k in take]), np.array([len(bags[k]) for k in take])
            g = _gradient(model, x, per, labels[take].astype(np.float64), weight[take])
            step += 1
            for k in model.p:
                g[k] = g[k] + 1e-4 * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                model.p[k] = model.p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _encode() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            x, per = passage_features(b.column("text"))
            at = np.concatenate([[0], np.cumsum(per)])
            own = [x[at[i] : at[i + 1]].tobytes() for i in range(len(per))]
            yield pa.record_batch([b.column("id"), b.column("label"), pa.array(own, pa.binary())], ["id", "label", "bag"])

    return run


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            y = model.scores(*passage_features(b.column("text")))
            yield pa.record_batch([b.column("id"), pa.array(y, pa.float64())], ["id", "score"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = PER_CLASS,
) -> Model:
    """A model of the labels of at most 2 * per_class documents, with all their passages.

    Rows that repeat an id count once, by the first text in their order.
    """
    python_ready(docs.sparkSession)
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
    )
    share = known.agg(F.avg("label")).first()[0]
    picked = [
        known.filter(F.col("label") == y).select("id", "label").orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)
    ]
    sample = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(
        F.broadcast(picked[0].unionByName(picked[1])), "id"  # at most 2 * per_class rows
    )
    sample = sample.groupBy("id", "label").agg(F.min("text").alias("text"))
    kind = dict(sample.dtypes)["id"]
    rows = sample.select("id", "label", "text").mapInArrow(_encode(), f"id {kind}, label int, bag binary").collect()
    rows.sort(key=lambda r: (r.id, r.bag))
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows]
    if not bags:
        return Model(None, np.zeros(FEATURES), np.ones(FEATURES), 0.5 if share is None else float(share))
    return train(bags, np.array([r.label for r in rows]), float(share))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_score(model), f"id {kind}, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(~held_out()))
    found = score(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
