"""Sets of word shingles of whole texts, as sorted 64-bit hashes, vectorised over the bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _PRIME, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_hashes(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of its first byte) of lower-cased bytes; starts_at: where texts begin."""
    fill = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts_at] = True
    first = fill.copy()
    first[1:] &= ~fill[:-1] | edge[1 : len(data)]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), start
    word = np.cumsum(first) - 1
    at = np.flatnonzero(fill)
    place = at - start[word[at]]
    value = (data[at].astype(np.uint64) + np.uint64(1)) * _power(int(place.max()) + 1)[place]
    runs = np.searchsorted(at, start)
    length = np.diff(np.append(runs, len(at))).astype(np.uint64)
    return mix(np.add.reduceat(value, runs) + length * np.uint64(0xD6E8FEB86659FD93)), start


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and where each begins and the last ends."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and len(bounds) else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of its first byte) of lower-cased bytes, in blocks that end at white space; bounds: of the
    texts in them."""
    hashes, places, i = [], [], 0
    while i < len(data):
        end = min(len(data), i + BLOCK)
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[i:end]])
            if len(gaps):
                end = i + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        inside = bounds[(bounds >= i) & (bounds < end)] - i
        h, p = _block_hashes(data[i:end], inside)
        hashes.append(h)
        places.append(p + i)
        i = end
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of `words` words; fewer words: one shingle; none: empty."""
    data, bounds = raw_bytes(texts)
    hashes, places = word_hashes(lowered(data), bounds)
    at = np.searchsorted(places, bounds)
    full = max(0, len(hashes) - words + 1)
    shingles = np.zeros(full, np.uint64)
    for k in range(words):
        shingles = mix(shingles * _PRIME + hashes[k : k + full])
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= words:
            yield np.unique(shingles[s : e - words + 1])
        elif e > s:
            whole = np.full(1, e - s, np.uint64)
            for h in hashes[s:e]:
                whole = mix(whole * _PRIME + h)
            yield whole
        else:
            yield np.zeros(0, np.uint64)
