"""Token-id output as length-delimited binary records, with an offset index for shuffled reads.

A record: the payload's length (8 bytes, little-endian), the masked checksum of those 8 bytes, the payload, the masked
checksum of the payload (4 bytes each). A payload: one byte with the width of an id (2 or 4), then the ids, little-
endian; ids below 65,536 take 2 bytes. A checksum is CRC-32, rotated right by 15 bits plus a fixed value, so that
checksums of data that holds checksums stay telling.

Documents are range-partitioned and sorted by id, so file after file and record after record they come in ascending
order; a task writes one file under a name of its own and renames it when it is whole, so a task that runs again, or
twice, leaves one whole file. The index, a Parquet table, has each record's file, offset and length; records can be
read in any order from it. Files lie in the shared folder, reached by its URI.

Cases: a null or empty text is a record of the end id alone; texts of any length are whole records; repeated ids are
records each, in the order of their texts' hashes; a null id comes first; an empty table gives no records; extra
columns are ignored. A record whose checksums don't hold raises an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, parts, python_ready, stage, whole_text
from .tokenizing import encoder, slices

END_ID = 2
#: Fixed value added to a rotated checksum.
MASK = 0xA282EAD8
HEAD, TAIL = 12, 4


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, end) of the record at a place; checks both checksums."""
    size = data[at : at + 8]
    if len(size) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(size):
        raise ValueError(f"record at {at}: its length is damaged")
    start = at + HEAD
    end = start + struct.unpack("<Q", size)[0]
    payload = data[start:end]
    if len(data) < end + TAIL or struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"record at {at}: its content is damaged")
    return payload, end + TAIL


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def unpack_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(path: str, folder: str, end_id: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, (store, base) = encoder(path), _open(folder)
        number = TaskContext.get().partitionId()
        name = f"part-{number:08d}.rec"
        draft = f"{base}/_{name}-{uuid.uuid4().hex}"
        place, before = 0, 0
        out = None
        try:
            for b in slices(batches, "text"):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(draft)
                ids, offsets = enc.ids(b.column("text"))
                at, size, count, ahead, buffer = [], [], [], [], []
                for i in range(b.num_rows):
                    seq = ids[offsets[i] : offsets[i + 1]]
                    if end_id is not None:
                        seq = np.append(seq, np.uint32(end_id))
                    record = frame(pack_ids(seq))
                    at.append(place)
                    size.append(len(record))
                    count.append(len(seq))
                    ahead.append(before)
                    place += len(record)
                    before += len(seq)
                    buffer.append(record)
                out.write(b"".join(buffer))
                cols = [pa.array(x, pa.int64()) for x in (at, size, count, ahead)]
                yield pa.record_batch(
                    [b.column("doc_id"), pa.array([number] * b.num_rows, pa.int64()), pa.array([name] * b.num_rows), *cols],
                    ["doc_id", "file_no", "file", "offset", "size", "n_tokens", "tokens_before"],
                )
        finally:
            if out is not None:
                out.close()
        if out is not None:
            store.move(draft, f"{base}/{name}")

    return run


def write_records(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int | None = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes folder/part-*.rec and folder/index (Parquet); returns the index.

    The index: doc_id, file_no, file, offset and size in bytes, n_tokens, tokens_before (in the same file).
    """
    python_ready(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("__h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts(spark), "doc_id", "__h").sortWithinPartitions("doc_id", "__h").drop("__h")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, file_no long, file string, offset long, size long, n_tokens long, tokens_before long"
    index = rows.mapInArrow(_write(tokenizer_path, folder, end_id), schema)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def _read(folder: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, source = None, None
        for b in batches:
            files, at, size = (b.column(c).to_pylist() for c in ("file", "offset", "size"))
            count, crc, own = [], [], []
            for f, o, n in zip(files, at, size, strict=True):
                if f != name:
                    if source is not None:
                        source.close()
                    name, source = f, store.open_input_file(f"{base}/{f}")
                source.seek(o)
                ids = unpack_ids(unframe(source.read(n))[0]).astype("<u4")
                raw = ids.tobytes()
                count.append(len(ids))
                crc.append(zlib.crc32(raw))
                own.append(raw)
            drop = {"n_tokens"}
            cols = [b.column(c) for c in b.schema.names if c not in drop]
            names = [c for c in b.schema.names if c not in drop]
            cols += [pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
            names += ["n_tokens", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(own, pa.binary())], [*names, "ids"]
            yield pa.record_batch(cols, names)
        if source is not None:
            source.close()

    return run


def read_records(index: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """The records that the index rows name, read in the order the rows come (with_ids: 4 bytes an id).

    Any subset or shuffle of the index can be read; its n_tokens is replaced by the count in the record.
    """
    python_ready(index.sparkSession)
    kept = [(n, t) for n, t in index.dtypes if n != "n_tokens"]
    schema = ", ".join(f"`{n}` {t}" for n, t in kept) + ", n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return index.mapInArrow(_read(folder, with_ids), schema)


def with_starts(records: DataFrame) -> DataFrame:
    """records (all of a folder's, as read) with start: the ids of all documents before, from the counts in the records."""
    files = records.groupBy("file_no").agg(F.sum("n_tokens").alias("own"))  # one row a file
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("own").over(ahead(Window.orderBy("file_no"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(ahead(Window.partitionBy("file_no").orderBy("offset"))), F.lit(0))
    rows = records.withColumn("inside", inside)  # a file is what one task wrote
    return rows.join(files, "file_no").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def op5_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "records")
    index = write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    found = stage(read_records(index, folder).select("doc_id", "file_no", "offset", "n_tokens", "ids_crc32"), "records-read")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")
