"""Exact token ids of whole texts at the price of encoding each distinct stretch once.

A tokenizer's pre-tokenizer cuts a text at places that no later step looks across. Where the tokenizer's own settings
show such places plainly, texts are cut there with Arrow's kernels, each distinct stretch of a batch is encoded once
by the library, and ids are put back by position with numpy. Texts in which a place can't be told plainly (two white
spaces together, unusual white space, NUL), and tokenizers with other settings, are encoded whole. Either way the ids
are the library's.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a Python worker.
SLICE_BYTES = 4 << 20
#: Texts in one call of the library.
CALL = 4096
#: Distinct stretches that a worker remembers between slices.
KNOWN = 300_000
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,!?;:%$#&*]"
_UNSURE = (
    r"[ \t\n][ \t\n]|[\x00\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_loaded: dict[str, Encoder] = {}


def file_digest(path: str) -> str:
    """The version of a tokenizer: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    """ids(texts) for an Arrow array of texts; nulls count as empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.cut = _cut(json.load(f))
        self._forget()

    def _each(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), CALL):  # the library's encodings are much larger than their ids
            out += [e.ids for e in self.tok.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)]
        return out

    def _known(self, words: list[str]) -> np.ndarray:
        """Places of words in the table of encoded stretches, which starts anew when it is full."""
        if len(self.place) > KNOWN:
            self._forget()
        place = self.place
        at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids = self._each(fresh)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
            first = len(self.first)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, flat])
            at[new] = np.arange(first, first + len(fresh))
            place.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return at

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text in them)."""
        texts = pc.fill_null(texts, "")
        if not self.cut:
            return _joined([np.array(x, np.uint32) for x in self._each(texts.to_pylist())])
        unsure = pc.match_substring_regex(texts, _UNSURE)
        lists = self.cut(pc.if_else(unsure, "", texts))
        coded = lists.flatten().dictionary_encode()
        index = self._known(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        per = self.length[index]
        ends = np.concatenate([[0], np.cumsum(per)])
        out = self.flat[np.repeat(self.first[index] - ends[:-1], per) + np.arange(ends[-1])]
        offsets = ends[_bounds(lists)]
        if not pc.any(unsure).as_py():
            return out, offsets
        rows = [out[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        at = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
        for i, ids in zip(at, self._each(texts.take(pa.array(at)).to_pylist()), strict=True):
            rows[i] = np.array(ids, np.uint32)
        return _joined(rows)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        texts = pc.fill_null(texts, "")
        if not self.cut:
            return np.fromiter(map(len, self._each(texts.to_pylist())), np.int64, len(texts))
        unsure = pc.match_substring_regex(texts, _UNSURE)
        lists = self.cut(pc.if_else(unsure, "", texts))
        coded = lists.flatten().dictionary_encode()
        at = self._known(coded.dictionary.to_pylist())  # may replace the table
        lengths = self.length[at]
        ends = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy()])])[_bounds(lists)]
        out = np.diff(ends)
        whole = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
        if len(whole):
            out[whole] = [len(x) for x in self._each(texts.take(pa.array(whole)).to_pylist())]
        return out


def _bounds(lists: pa.Array) -> np.ndarray:
    found = lists.offsets.to_numpy()
    return found - found[0]


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint32)), offsets


def _cut(settings: dict):
    """A function from texts to lists of stretches that the tokenizer treats alone, or None if its settings don't tell."""
    added = settings.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n.,!?;:%$#&*") for t in added):
        return None
    pre, normal = settings.get("pre_tokenizer") or {}, settings.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
        return _before_spaces
    steps = pre.get("pretokenizers") or [{}]
    kinds = [n.get("type") for n in (normal or {}).get("normalizers", [])]
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    if drops and r"[^\s\p{L}\p{N}]" in steps[0]["pattern"].get("Regex", "") and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
        return _at_white_space
    return None


def _at_white_space(texts: pa.Array) -> pa.Array:
    """Cuts at white space, which the tokenizer drops, and between a letter and a plain mark."""
    return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, f"({_LETTER})({_MARK})", "\\1 \\2"))


def _before_spaces(texts: pa.Array) -> pa.Array:
    """Cuts before single spaces, around single line ends, and between a letter and a plain mark."""
    out = pc.replace_substring(texts, " ", "\x00 ")
    out = pc.replace_substring(out, "\n", "\x00\n\x00")
    out = pc.replace_substring_regex(out, f"({_LETTER})({_MARK})", "\\1\x00\\2")
    return pc.split_pattern(out, "\x00")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of about `most` bytes of a column; a longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
