"""Length-delimited binary records of token ids, with a separate offset index.

A shard holds records one after another, each framed as: length of the payload (8 bytes), masked checksum of those 8
bytes (4), payload, masked checksum of the payload (4). All numbers are little-endian. The checksum is CRC-32; the
mask rotates it right by 15 bits and adds 0xa282ead8, so that checksums stored inside payloads do no harm. The
payload is: doc_id (8 bytes, signed), flags (1 byte: 1 if doc_id is null), bytes an id (1), and the ids. Ids take two
bytes when all ids of the tokenizer and the end id fit, else four. Beside NAME.bin lies NAME.idx: the offset of each record (8 bytes), so
that a reader can fetch the records in any order.

Writing: rows are dealt by ranges of doc_id, one shard a partition; a shard is written under a name of its own for
each attempt and is named in the manifest only if its task succeeded. A task that is repeated writes another file;
nothing refers to the first. Files go through pyarrow's file systems, so the folder may be in any store it knows.

Defined cases: a null text is an empty one (only the end id); null doc_ids come first; rows of equal or null doc_id are
ordered by a hash of the text, by which any number of them are split over shards, then by text; an empty table gives no
shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.shared import partitions
from cloakwork.llm.tokens import Encoder, batches

MASK = 0xA282EAD8
MANIFEST = "shard long, path string, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_LENGTH, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
#: Characters tokenized, and bytes read, at a time.
SLICE, BUFFER = 1_000_000, 4 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = _LENGTH.pack(len(payload))
    return b"".join((n, _SUM.pack(masked(n)), payload, _SUM.pack(masked(payload))))


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _HEAD.unpack_from(data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", offset=_HEAD.size)


def read_records(stream):
    """Payloads of an open shard; a damaged length or payload raises ValueError."""
    while head := stream.read(_LENGTH.size + _SUM.size):
        if len(head) < 12 or masked(head[:8]) != _SUM.unpack_from(head, 8)[0]:
            raise ValueError("damaged record length")
        (n,) = _LENGTH.unpack_from(head)
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked(body[:n]) != _SUM.unpack_from(body, n)[0]:
            raise ValueError("damaged record")
        yield body[:n]


def read_at(path: str, wanted: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of the given numbers of one shard, by its index, in the given order."""
    fs, p = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(p.removesuffix(".bin") + ".idx") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    with fs.open_input_file(p) as f:
        out = []
        for i in wanted:
            f.seek(int(offsets[i]))
            out.append(parse(next(read_records(f))))
        return out


def _write_part(folder: str, tokenizer: str, kind: str, end_id: int):
    def run(parts):
        encoder = Encoder.of(tokenizer, kind)
        width = 2 if max(encoder.highest, end_id) < 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        path, out, offsets, at, docs, tokens = f"/shard-{shard:06d}-{uuid.uuid4().hex}.bin", None, [], 0, 0, 0
        for batch in parts:
            ids_of, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches(texts, [len(t) for t in texts], SLICE):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(base + path, buffer_size=BUFFER)
                ids, per = encoder.encode(texts[a:b])
                ends = np.cumsum(per)
                for doc, n, e in zip(ids_of[a:b], per.tolist(), ends.tolist()):
                    record = frame(payload(doc, np.append(ids[e - n : e], end_id), width))
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                docs += b - a
                tokens += int(per.sum()) + b - a
        if out is not None:
            out.close()
            with fs.open_output_stream((base + path).removesuffix(".bin") + ".idx") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [folder + path], "docs": [docs], "tokens": [tokens]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "word", end_id: int = 1) -> list[dict]:
    """Write docs(doc_id, text) as shards in ascending doc_id order; the manifest, one entry a shard (bounded by the
    number of partitions), in order, with the ids before each shard as `start`."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    shards = sorted((r.asDict() for r in ordered.mapInArrow(_write_part(folder, tokenizer, kind, end_id), MANIFEST).collect()), key=lambda r: r["shard"])
    start = 0
    for s in shards:
        s["start"] = start
        start += s["tokens"]
    return shards


def _read_part(parts):
    for batch in parts:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, p = pa.fs.FileSystem.from_uri(path)
            out: list[tuple] = []
            with fs.open_input_stream(p, buffer_size=BUFFER) as f:
                for data in read_records(f):
                    doc_id, ids = parse(data)
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) >= 10_000:
                        yield _batch(out)
                        out = []
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files."""
    frame_ = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    return frame_.repartition(max(1, len(shards))).mapInArrow(_read_part, ROWS)
