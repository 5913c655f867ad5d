"""Token operators against the libraries, and exact round trips."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from helpers import awkward, frame, write_tables

from loomrank.llm import nbest_segmentation, packing, token_counts, token_records, tokenizing

BYTE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path):
    rng = random.Random(1)
    alphabet = " \n\tab'sé.,!<|>1 "
    texts = [t for _, t in awkward()] + ["a<|endoftext|> b", "it's  two", "x<|startoftext|>.y", "  a", "A.<|endoftext|>\n"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    enc = tokenizing.Encoder(path)
    half = texts[::2]
    assert enc.counts(pa.array(half, pa.string())).tolist() == [len(x) for x in library(path, half)]
    ids, at = enc.ids(pa.array(texts, pa.string()))
    want = library(path, texts)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    assert enc.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenizing, "KNOWN", 3)
    enc = tokenizing.Encoder(BYTE)
    for t in ("a b c d e f", "a b x y", "c d"):
        assert enc.ids(pa.array([t]))[0].tolist() == library(BYTE, [t])[0]


def test_counts_and_cache(spark, tmp_path):
    rows = awkward()
    cache = f"file://{tmp_path}/cache"
    want = {i: (len((t or "").encode()), len(x)) for (i, t), x in zip(rows, library(WORD, [t for _, t in rows]), strict=True)}
    for part in (rows[:20], rows, rows):
        got = token_counts.token_counts(frame(spark, part), WORD, cache).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: want[i] for i, _ in part}
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len({t or "" for _, t in rows}) == stored.select("digest").distinct().count()
    other = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, rows), BYTE, cache).collect()}
    assert other == {i: len(x) for (i, _), x in zip(rows, library(BYTE, [t for _, t in rows]), strict=True)}
    assert token_counts.token_counts(frame(spark, rows).limit(0), WORD, f"file://{tmp_path}/none").isEmpty()


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing(spark):
    rows = awkward()
    ids = {i: [*x, 2] for (i, _), x in zip(rows, library(BYTE, [t for _, t in rows]), strict=True)}
    got = packing.pack_documents(frame(spark, rows), BYTE, open_bins=8, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == [sum(p.length for p in pieces[:n]) for n in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(ids[i])
        assert all(p.length == 1024 for p in pieces[1:]) and (len(pieces) > 1) == (len(ids[i]) > 1024)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(p.length for p in pieces[:n]) for n in range(len(pieces))]
        assert sum(p.length for p in pieces) <= 1024
    assert packing.pack_documents(frame(spark, rows).limit(0), BYTE).isEmpty()


def test_best_fit_bins():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 1)
    assert [bins.place(n) for n in (6, 7, 4)] == [(0, 0), (1, 0), (0, 6)]  # the fuller bin closed
    rng = random.Random(4)
    lengths = [rng.randint(1, 1024) for _ in range(4000)]
    bins = packing.BestFit(1024, 4096)
    used = {bins.place(n)[0] for n in sorted(lengths, reverse=True)}
    assert len(used) <= 1.02 * sum(lengths) / 1024 + 1


def test_records(spark, tmp_path):
    rows = awkward()
    want = {i: [*x, 2] for (i, _), x in zip(rows, library(BYTE, [t for _, t in rows]), strict=True)}
    folder = f"file://{tmp_path}/records"
    index = token_records.write_records(frame(spark, rows), BYTE, folder)
    found = token_records.with_starts(token_records.read_records(index, folder, with_ids=True)).collect()
    start = 0
    for r in sorted(found, key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), crc(want[r.doc_id]))
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        start += r.n_tokens
    assert len(found) == len(rows)
    shuffled = index.orderBy("size", "doc_id").limit(7)
    assert all(r.ids_crc32 == crc(want[r.doc_id]) for r in token_records.read_records(shuffled, folder).collect())
    files = [f for f in (tmp_path / "records").iterdir() if f.suffix == ".rec"]
    data = b"".join(f.read_bytes() for f in sorted(files))
    at, seen = 0, []
    while at < len(data):
        payload, at = token_records.unframe(data, at)
        seen.append(token_records.unpack_ids(payload).tolist())
    assert seen == [want[i] for i in sorted(want)]
    empty = token_records.write_records(frame(spark, rows).limit(0), BYTE, f"file://{tmp_path}/none")
    assert empty.isEmpty()


def test_record_frames():
    for ids in ([], [1, 2], [70000]):
        payload = token_records.pack_ids(np.array(ids, np.uint32))
        assert token_records.unpack_ids(payload).tolist() == ids
        framed = token_records.frame(payload)
        assert token_records.unframe(framed) == (payload, len(framed))
        for i in range(len(framed)):
            damaged = framed[:i] + bytes([framed[i] ^ 1]) + framed[i + 1 :]
            with pytest.raises(ValueError):
                token_records.unframe(damaged)


def nbest_brute(model, text, n):
    """All paths' N best by extending N best prefixes, over the whole text at once."""
    t = (nbest_segmentation.SPACE + text).replace(" ", nbest_segmentation.SPACE) if text else ""
    best = [[(0.0, ())]] + [[] for _ in t]
    for e in range(1, len(t) + 1):
        ways = [(a + s, i + ids) for start, s, ids in model._spans(t, e) for a, i in best[start]]
        best[e] = sorted(ways, key=lambda x: -x[0])[:n]
    return best[-1]


def test_nbest():
    rng = random.Random(2)
    model = nbest_segmentation.lattice(PIECE)
    assert model.separable
    texts = [None, "", "a", " x", "a  b", "hello world, it's.", "x\ny\n\nz", "日本ｱ éa.b", "▁q ▁", "\x00 a", "b" * 60]
    texts += ["".join(rng.choice("abthe. ,\né") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    for n in (1, 4):
        for text, got in zip(texts, model.encode(pa.array(texts, pa.string()), n), strict=True):
            want = nbest_brute(model, text or "", n)
            assert [s for s, _ in got] == [s for s, _ in want]
            assert len({tuple(i) for _, i in got}) == len(got)
            for _, ids in got:
                assert model.decode(ids) == (text or "").replace(nbest_segmentation.SPACE, " ")


@pytest.mark.parametrize("text", ["-" * 20_000, "a" * 20_000, "\u65e5\u672c\u8a9e" * 7_000, "\u20ac" * 20_000, "ab1" * 7_000])
def test_nbest_of_long_even_stretches(text):
    """Ties and long stretches take time in proportion to their length."""
    import time

    model = nbest_segmentation.lattice(PIECE)
    began = time.perf_counter()
    found = model.nbest(text, 4)
    assert time.perf_counter() - began < 10
    assert len(found) == len({ids for _, ids in found}) == (4 if text.isascii() else 1)  # one piece a character, no other
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    for _, ids in found:
        assert b"".join(bytes(model.raw[model.raw_first[i] : model.raw_first[i] + model.raw_length[i]]) for i in ids).decode() == text


def test_nbest_tables(spark, tmp_path):
    rows = [r for r in awkward() if len(r[1] or "") < 50_000]
    got = nbest_segmentation.encode_nbest(frame(spark, rows), PIECE)
    ids = got.selectExpr("doc_id", "nbest[0].ids as ids", "size(nbest) as n")
    back = {r.doc_id: r.text for r in nbest_segmentation.decode_ids(ids, PIECE).collect()}
    assert back == {i: t or "" for i, t in rows}
    path = write_tables(spark, tmp_path, rows)
    digest = {r.doc_id: r for r in nbest_segmentation.op6_nbest_segmentation(spark, path).collect()}
    first = {r.doc_id: r.ids for r in ids.collect()}
    for i, _ in rows:
        assert digest[i].round_trip and digest[i].n_pieces == len(first[i])
        assert digest[i].ids_crc32[0] == crc(first[i])
        assert digest[i].scores == sorted(digest[i].scores, reverse=True)
