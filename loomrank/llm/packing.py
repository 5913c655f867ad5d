"""Best-fit packing of token sequences into fixed-length training sequences.

Bounded-space online best-fit: each task keeps at most OPEN_BINS open bins in lists by free space, and one bit for each
free space that has a bin. The best fit of a piece is the lowest set bit at or above its length; when bins are too
many, the fullest closes first (the lowest set bit). Pieces arrive in blocks as long as the bins are many, longest
first within a block, which leaves about as few sequences as sorting everything would, at the same bounded memory.

A document is its token ids and an end id. Only one longer than a sequence is cut, the first piece being the short
one, so that all its other pieces fill a sequence by themselves.

Pieces are dealt to tasks by a hash of all their fields, a fixed number of pieces a task, so neither a source nor a
group of copies lands together; a task's input is sorted, so a task that runs again packs alike.

Cases: a null or empty text is a piece of the end id alone; texts of any length are cut, none is dropped; repeated rows
are packed each; null ids are packed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, stage, whole_text
from .tokenizing import encoder, slices

CAPACITY, END_ID = 1024, 2
OPEN_BINS, PIECES_PER_TASK = 4096, 50_000


class BestFit:
    """Open bins by free space, and a bit for each free space that has one."""

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        self.capacity, self.most, self.next = capacity, open_bins, first_id
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        self.count -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            into = self._take(free)
        else:
            free, into = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(into)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return into, self.capacity - free


def piece_schema(id_type: str, with_ids: bool = False) -> str:
    return f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids


def _pieces(path: str, end_id: int | None, capacity: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text"):
            ids, offsets = enc.ids(b.column("text"))
            rows, piece, start, length, crc, own = [], [], [], [], [], []
            for i in range(b.num_rows):
                seq = ids[offsets[i] : offsets[i + 1]].astype("<u4")
                if end_id is not None:
                    seq = np.append(seq, np.array([end_id], "<u4"))
                n = len(seq)
                cuts = [0, *range(n % capacity or min(capacity, n), n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
                    raw = seq[s:e].tobytes()
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw))
                    own.append(raw)
            out = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            out += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(own, pa.binary())], [*names, "ids"]
            yield pa.record_batch(out, names)

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int | None = END_ID,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (with_ids: and the ids, 4 bytes each)."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(
        _pieces(tokenizer_path, end_id, capacity, with_ids), piece_schema(dict(rows.dtypes)["doc_id"], with_ids)
    )


def _pack(capacity: int, open_bins: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)

        def packed(block: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(block).combine_chunks()
            lengths = rows.column("length").to_numpy()
            to, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                to[i], at[i] = bins.place(int(lengths[i]))
            rows = rows.append_column("sequence_id", pa.array(to)).append_column("offset", pa.array(at))
            return rows.to_batches()[0]

        block, held = [], 0
        for b in batches:
            while b.num_rows:
                block.append(b.slice(0, open_bins - held))
                held += block[-1].num_rows
                b = b.slice(block[-1].num_rows)
                if held == open_bins:
                    yield packed(block)
                    block, held = [], 0
        if held:
            yield packed(block)

    return run


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK
) -> DataFrame:
    """pieces (a column length, at most capacity, at least 1) with sequence_id and offset."""
    python_ready(pieces.sparkSession)
    tasks = max(2, -(-pieces.count() // pieces_per_task))
    cols = [F.col(c) for c in pieces.columns]
    dealt = pieces.repartition(tasks, F.xxhash64(*cols)).sortWithinPartitions(F.xxhash64(*cols), *cols)
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return dealt.mapInArrow(_pack(capacity, open_bins), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, **kw) -> DataFrame:
    """The pieces of docs and where each lies in the packed sequences."""
    with_ids = kw.pop("with_ids", False)
    return pack(stage(token_pieces(docs, tokenizer_path, with_ids=with_ids), "pieces"), **kw)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
