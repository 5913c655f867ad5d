"""SentencePiece encoding and decoding with the N best segmentations.

A text's segmentations are the paths of the lattice of a model's pieces over the normalised text, a path's score the
sum of its pieces' stored scores. Forward Viterbi gives, for every place, the best score from the start; backward A*
search from the end takes partial paths in the order of their own score plus that forward score, which is exact, so
paths complete in order, best first. No place is opened more than N times, as N paths that are no worse go on from there,
so a stretch of many equally good segmentations takes time in proportion to its length.

No piece of the model spans the start of a word, a line end, or a letter and a plain mark (checked against its pieces
when it is loaded), so the lattice falls apart into stretches there and the N best of a text combine those of its
stretches. Forward scores of all distinct stretches of a batch are computed together in numpy, with the second best
beside the best; the N best of a text differ from the best in no other stretches than the N - 1 whose second best
costs least, so A* runs on those only. That is exact, and whole texts are covered.

Where no piece covers a character, its UTF-8 bytes' pieces stand for it, at one fixed score below every piece's.
The installed library offers N-best for unigram models only; this works with any model's scores. With a merge model's
scores the best path need not be the library's own merge order.

Cases: a null or empty text has no pieces, one segmentation of score 0; texts of any length are covered; fewer than N
segmentations: as many as there are; ties go to the order of the search, which is the same in every run; repeated rows
and null ids pass through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, whole_text
from .tokenizing import slices

N = 4
SPACE = "\u2581"
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,!?;:%$#&*]"
KNOWN = 400_000
LONGEST = 48
_loaded: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One lattice a process and model file."""
    if path not in _loaded:
        _loaded[path] = Lattice(path)
    return _loaded[path]


class Lattice:
    """Segmentations over a model's pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {names[i]: (i, float(sp.get_score(i))) for i in plain}
        self.byte_id = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - 10
        self.longest = max(map(len, self.pieces))
        #: For decoding: each id's bytes.
        raw = [b""] * size
        for p, (i, _) in self.pieces.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            raw[i] = bytes([b])
        self.raw, self.raw_length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.raw_first = np.cumsum(self.raw_length) - self.raw_length
        inner = re.compile(f"[^{SPACE}]{SPACE}|.\n|\n.|{_LETTER}{_MARK}", re.S)
        self.separable = not any(inner.search(p) for p in self.pieces)
        self.marks = re.compile(f"(?<={_LETTER})(?={_MARK})|(?<=\n)|(?=\n)|(?<=[^{SPACE}])(?={SPACE})")
        # pieces by a polynomial hash of their characters
        keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        assert len(np.unique(keys)) == len(keys)
        self.key_id = np.array([v[0] for v in self.pieces.values()])[order]
        self.key_score = np.array([v[1] for v in self.pieces.values()])[order]
        self._forget()

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self._BASE) + ord(c) + 1) % 2**64
        return h

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.words: list[str] = []
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.first, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.few: dict[str, list] = {}

    # one stretch

    def _spans(self, text: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of what may end at a place."""
        out = []
        for start in range(max(0, end - self.longest), end):
            found = self.pieces.get(text[start:end])
            if found:
                out.append((start, found[1], (found[0],)))
        if not out or out[-1][0] != end - 1:
            ids = tuple(self.byte_id.get(b, 0) for b in text[end - 1].encode("utf-8", "replace"))
            out.append((end - 1, self.unknown, ids))
        return out

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a stretch, best first."""
        ends = [[]] + [self._spans(text, e) for e in range(1, len(text) + 1)]
        forward = [0.0]
        for e in range(1, len(text) + 1):
            forward.append(max(forward[s] + score for s, score, _ in ends[e]))
        out: list[tuple[float, tuple[int, ...]]] = []
        turn = 0
        opened = [0] * (len(text) + 1)
        agenda = [(-forward[-1], len(text), turn, 0.0, None)]  # of equal ones, the nearest to completion first
        while agenda and len(out) < n:
            _, at, _, score, tail = heapq.heappop(agenda)
            if opened[at] == n:  # n paths that are no worse go through here already
                continue
            opened[at] += 1
            if at == 0:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((score, tuple(ids)))
                continue
            for start, s, ids in ends[at]:
                turn += 1
                if opened[start] < n:
                    heapq.heappush(agenda, (-(forward[start] + s + score), start, turn, s + score, (ids, tail)))
        return out

    # many stretches

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of words in the table of best and second-best segmentations, which starts anew when it is full."""
        if len(self.place) > KNOWN:
            self._forget()
        at = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        fresh = [words[i] for i in new.tolist()]
        best, loss, ids = np.zeros(len(fresh)), np.full(len(fresh), np.inf), [()] * len(fresh)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(fresh):
            if w:
                groups.setdefault(len(w) if len(w) <= LONGEST else 0, []).append(k)
        for size, which in groups.items():
            some = self._viterbi([fresh[k] for k in which], size) if size else [False] * len(which)
            for j, k in enumerate(which):
                if size and some[0][j]:
                    best[k], loss[k], ids[k] = some[1][j], some[2][j], some[3][j]
                else:
                    found = self.nbest(fresh[k], 2)
                    best[k], ids[k] = found[0]
                    loss[k] = best[k] - found[1][0] if len(found) > 1 else np.inf
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.words)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))])
        self.best, self.loss = np.concatenate([self.best, best]), np.concatenate([self.loss, loss])
        self.words += fresh
        at[new] = np.arange(begin, begin + len(fresh))
        self.place.update(zip(fresh, range(begin, begin + len(fresh)), strict=True))
        return at

    def _viterbi(self, words: list[str], size: int):
        """(whether pieces cover a word, best score, loss of the second best, ids) of words of one length."""
        w = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(w, size).astype(np.uint64)
        prefix = np.zeros((size + 1, w), np.uint64)
        power = np.cumprod(np.append(np.uint64(1), np.full(size, self._BASE, np.uint64)), dtype=np.uint64)
        for e in range(size):
            prefix[e + 1] = prefix[e] * self._BASE + codes[:, e] + np.uint64(1)
        top, second = np.full((size + 1, w), -np.inf), np.full((size + 1, w), -np.inf)
        came, piece = np.zeros((size + 1, w), np.int64), np.zeros((size + 1, w), np.int64)
        top[0] = 0
        for e in range(1, size + 1):
            for s in range(max(0, e - self.longest), e):
                h = prefix[e] - prefix[s] * power[e - s]
                k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[k] == h)
                if not len(hit):
                    continue
                k = k[hit]
                one, two = top[s, hit] + self.key_score[k], second[s, hit] + self.key_score[k]
                old = top[e, hit]
                second[e, hit] = np.maximum(np.minimum(old, one), np.maximum(second[e, hit], two))
                better = one > old
                to = hit[better]
                top[e, to], came[e, to], piece[e, to] = one[better], s, self.key_id[k[better]]
        # a character that no piece covers alone: left to the search of one stretch
        single = np.isin(codes.ravel(), np.array([ord(p) for p in self.pieces if len(p) == 1], np.uint64)).reshape(w, size)
        covered = single.all(axis=1)
        ids: list[list[int]] = [[] for _ in range(w)]
        at = np.where(covered, size, 0)
        rows = np.flatnonzero(at > 0)
        while len(rows):
            got = piece[at[rows], rows].tolist()
            for r, p in zip(rows.tolist(), got, strict=True):
                ids[r].append(p)
            at[rows] = came[at[rows], rows]
            rows = rows[at[rows] > 0]
        with np.errstate(invalid="ignore"):
            loss = top[size] - second[size]
        return covered, top[size], loss, [x[::-1] for x in ids]

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(index of each stretch, where each text's begin, the distinct stretches)."""
        odd = pc.match_substring_regex(texts, "^ |  |\x00|" + SPACE)
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(SPACE, texts, ""))
        marked = pc.replace_substring(marked, " ", SPACE)
        if not self.separable:
            lists = pa.array([[x] for x in marked.to_pylist()], pa.list_(pa.string()))
        else:
            cut = pc.replace_substring(pc.if_else(odd, "", marked), SPACE, "\x00" + SPACE)
            cut = pc.replace_substring(cut, "\n", "\x00\n\x00")
            cut = pc.replace_substring_regex(cut, f"({_LETTER})({_MARK})", "\\1\x00\\2")
            lists = pc.split_pattern(cut, "\x00")
            if pc.any(odd).as_py():
                rows = lists.to_pylist()
                for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                    rows[i] = self.marks.split(marked[i].as_py())
                lists = pa.array(rows, pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy()
        return coded.indices.to_numpy(), bounds - bounds[0], coded.dictionary.to_pylist()

    def encode(self, texts: pa.Array, n: int) -> list[list[tuple[float, np.ndarray]]]:
        """The n best (score, ids) of each text."""
        texts = pc.fill_null(texts, "")
        index, bounds, words = self._stretches(texts)
        index = self._learn(words)[index] if len(words) else index
        out = []
        for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            seg = index[b:e]
            per = self.length[seg]
            ends = np.cumsum(per)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.repeat(self.first[seg] - (ends - per), per) + np.arange(total)]
            score = float(self.best[seg].sum())
            loss = self.loss[seg]
            near = np.flatnonzero(np.isfinite(loss))
            if len(near) > n - 1:
                cut = np.partition(loss[near], n - 2)[n - 2] if n > 1 else -np.inf
                near = near[loss[near] <= cut]
                near = near[np.argsort(loss[near], kind="stable")][: n - 1]
            ways: list[tuple[float, tuple]] = [(0.0, ())]
            for k in near.tolist():
                options = self._options(self.words[seg[k]], n)
                ways = sorted(
                    ((lost + options[0][0] - s, picks + ((k, alt),) if j else picks) for lost, picks in ways for j, (s, alt) in enumerate(options)),
                    key=lambda x: x[0],
                )[:n]
            found = []
            for lost, picks in ways:
                if not picks:
                    found.append((score, ids))
                    continue
                parts, last = [], 0
                for k, alt in sorted(picks):
                    parts += [ids[last : ends[k] - per[k]], np.array(alt, np.uint32)]
                    last = ends[k]
                found.append((score - lost, np.concatenate([*parts, ids[last:]])))
            out.append(found)
        return out

    def _options(self, word: str, n: int) -> list:
        if len(self.few) > KNOWN // 10:
            self.few = {}
        if (word, n) not in self.few:
            self.few[word, n] = self.nbest(word, n)
        return self.few[word, n]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces' characters, the first one's leading space left out; damaged bytes are replaced."""
        per = self.raw_length[ids]
        ends = np.cumsum(per)
        total = int(ends[-1]) if len(ends) else 0
        data = self.raw[np.repeat(self.raw_first[ids] - (ends - per), per) + np.arange(total)].tobytes()
        return data.removeprefix(b" ").decode("utf-8", "replace")


def _encode(path: str, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for b in slices(batches, "text"):
            for few in slices(iter([b]), "text", 1 << 20):
                rows = [[{"score": s, "ids": i.astype(np.int32)} for s, i in r] for r in model.encode(few.column("text"), n)]
                yield pa.record_batch([few.column("doc_id"), pa.array(rows, kind)], ["doc_id", "nbest"])

    return run


def _digest(path: str, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for b in slices(batches, "text"):
            texts = pc.fill_null(b.column("text"), "")
            size, best, scores, crcs, same = [], [], [], [], []
            for found, text in zip(model.encode(texts, n), texts.to_pylist(), strict=True):
                size.append(len(found[0][1]))
                best.append(found[0][0])
                scores.append([s for s, _ in found])
                crcs.append([zlib.crc32(i.astype("<u4").tobytes()) for _, i in found])
                same.append(all(model.decode(i) == text for _, i in found))
            yield pa.record_batch(
                [
                    b.column("doc_id"), pa.array(size, pa.int64()), pa.array(best, pa.float64()),
                    pa.array(scores, pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(same, pa.bool_()),
                ],
                ["doc_id", "n_pieces", "best_score", "scores", "ids_crc32", "round_trip"],
            )

    return run


def encode_nbest(docs: DataFrame, model_path: str, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and nbest: array<struct<score, ids>>, best first."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_encode(model_path, n), f"doc_id {kind}, nbest array<struct<score: double, ids: array<int>>>")


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """rows with the text of a column of ids (array<int>)."""
    python_ready(rows.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != into) + f", `{into}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path)
        for b in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in b.column(ids_col).to_pylist()]
            names = [c for c in b.schema.names if c != into]
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(texts, pa.string())], [*names, into])

    return rows.mapInArrow(run, schema)


def nbest_digests(docs: DataFrame, model_path: str, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces and best_score of the best; scores and ids_crc32 of the n best; whether all of them decode to
    the text."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_pieces long, best_score double, scores array<double>, ids_crc32 array<long>, round_trip boolean"
    return rows.mapInArrow(_digest(model_path, n), schema)


def op6_nbest_segmentation(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return nbest_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
