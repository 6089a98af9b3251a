"""Token sequences in length-delimited binary records, with a separate index of offsets for shuffled reads.

A record: length of the payload (8 bytes), masked checksum of these 8 bytes (4), payload, masked checksum of the payload (4), all
little-endian. The payload: 1 if there is a document id else 0 (1 byte), the id (8), the token ids (2 bytes each if the vocabulary
fits, else 4). Checksums are CRC-32, rotated and shifted by a constant, so that checksums of data that hold checksums stay sound.
Shard k is part-<k>.rec; part-<k>.idx holds the width of ids (8 bytes), then the offset of each record (8 bytes each). Writers make
temporary files and rename them, so that a task can run again after an executor is lost.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import bytebpe
from docspark.llm.common import new_path, small_batches

HEAD, TAIL, ID = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")
END_ID = 0


class BadRecord(ValueError):
    """A checksum or a length doesn't fit."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload))


def record_of(doc_id: int | None, tokens: bytes) -> bytes:
    return frame(ID.pack(doc_id is not None, doc_id or 0) + tokens)


def read_frame(stream) -> bytes | None:
    """The next payload of a file, or None at its end."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        raise BadRecord("length")
    n = HEAD.unpack(head)[0]
    rest = stream.read(n + TAIL.size)
    if len(rest) < n + TAIL.size or masked(rest[:n]) != TAIL.unpack(rest[n:])[0]:
        raise BadRecord("payload")
    return rest[:n]


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write_batches(uri: str, path: str, end_id: int):
    def run(batches):
        context = TaskContext.get()
        shard = context.partitionId()
        enc = bytebpe.encoder(path)
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        fs, root = _open(uri)
        fs.create_dir(root, recursive=True)
        name, own = f"{root}/part-{shard:06d}", f".{context.taskAttemptId()}.tmp"
        offsets, at, ids = [], 0, 0
        with fs.open_output_stream(f"{name}.rec{own}", buffer_size=1 << 20) as out:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    tokens = enc.encode(text) + end
                    record = record_of(doc_id, tokens)
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    ids += len(tokens) // enc.width
        with fs.open_output_stream(f"{name}.idx{own}") as out:
            out.write(np.array([enc.width, *offsets], "<u8").tobytes())
        for kind in ("idx", "rec"):
            fs.move(f"{name}.{kind}{own}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "records": pa.array([len(offsets)]), "ids": pa.array([ids])})

    return run


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID) -> list[tuple[int, int, int]]:
    """Writes docs(doc_id, text, ...) in ascending doc_id order (null ids first, ties by text) and returns (shard, records, ids) in order.

    Null and empty texts give the end id alone; repeated rows give a record each; other columns are not read. The list has one
    entry for each shard, as many as shuffle partitions at most.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = rows.mapInArrow(_write_batches(uri, tokenizer, end_id), "shard int, records long, ids long")
    return sorted(tuple(r) for r in done.collect())


def payloads(uri: str, shard: int):
    """(doc_id, ids as an array) of a shard's records, in order."""
    fs, root = _open(uri)
    with fs.open_input_stream(f"{root}/part-{shard:06d}.idx") as f:
        width = int(np.frombuffer(f.read(8), "<u8")[0])
    with fs.open_input_stream(f"{root}/part-{shard:06d}.rec", buffer_size=1 << 20) as f:
        while (payload := read_frame(f)) is not None:
            yield _parsed(payload, width)


def _parsed(payload: bytes, width: int):
    known, doc_id = ID.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=ID.size)


def read_at(uri: str, shard: int, k: int):
    """(doc_id, ids) of record k of a shard, by the index."""
    fs, root = _open(uri)
    with fs.open_input_file(f"{root}/part-{shard:06d}.idx") as f:
        width = int(np.frombuffer(f.read_at(8, 0), "<u8")[0])
        offset = int(np.frombuffer(f.read_at(8, 8 * (k + 1)), "<u8")[0])
    with fs.open_input_file(f"{root}/part-{shard:06d}.rec") as f:
        f.seek(offset)
        return _parsed(read_frame(f), width)


def _read_batches(uri: str, shards: list[tuple[int, int, int]], each):
    starts = dict(zip([s for s, _, _ in shards], np.cumsum([0, *(n for _, _, n in shards)])[:-1].tolist(), strict=True))

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                shard = shards[k][0]
                at, rows = starts[shard], []
                for doc_id, ids in payloads(uri, shard):
                    rows.append((doc_id, at, len(ids), each(ids)))
                    at += len(ids)
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return run


def _batch(rows):
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_digests(spark: SparkSession, uri: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record; checksums are verified on the way. A task reads one shard as a stream."""
    n = max(1, len(shards))
    rows = spark.range(0, len(shards), 1, n)
    return rows.mapInArrow(_read_batches(uri, shards, crc_of_ids), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs in the shared folder and reads the files back as digests: one row for each input row."""
    uri = new_path(docs.sparkSession, "records")
    return read_digests(docs.sparkSession, uri, write(docs, uri, tokenizer))
