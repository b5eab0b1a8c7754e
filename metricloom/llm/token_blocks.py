"""Token-ID output in patched frame-of-reference blocks.

Documents are put in order by a range partitioning, each partition (a *shard*) streams their ids into *segments*, and a
segment holds fixed-size blocks: the block's minimum is subtracted, the rest is packed at the width that covers a given
share of the block, and what does not fit is kept whole in the block's exception list. A block index in the segment says
where each block starts, so a reader can begin at any block.

Segments are rows of a Parquet table, so that Spark's own committer makes them appear once, on any file system, whatever
tasks are tried again. Columns: shard, segment, first_id (ids of the shard before the segment), doc_ids, doc_lengths,
n_ids, payload. Layout of a payload, all little-endian:

    magic u32, block size u32, ids u32, blocks u32
    block index, one entry a block: start of its bits u32, start of its exceptions u32, minimum u32, width u8
    packed bits of all blocks, each block byte-aligned, low bit first
    exceptions of all blocks: positions u16 (all), then values above the minimum u32 (all)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches
from .pieces import encoder

MAGIC = 0x50464F52
BLOCK = 256
SEGMENT_IDS = 1 << 16
#: Documents that a worker is handed at once.
BATCH = 2048
#: Share of a block's ids that the packed width covers; the others are exceptions.
COVERED = 0.95

_INDEX = np.dtype([("bits", "<u4"), ("exceptions", "<u4"), ("minimum", "<u4"), ("width", "u1")])


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)  # exact below 2**53


def pack(ids: np.ndarray, block: int = BLOCK, covered: float = COVERED) -> bytes:
    """One segment's payload."""
    n = len(ids)
    blocks = -(-n // block)
    head = np.array([MAGIC, block, n, blocks], "<u4").tobytes()
    if not n:
        return head
    grid = np.full(blocks * block, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, block)
    index = np.zeros(blocks, _INDEX)
    index["minimum"] = grid.min(axis=1)
    delta = grid - index["minimum"][:, None]
    k = min(block - 1, max(0, int(np.ceil(covered * block)) - 1))
    widths = _bit_lengths(np.partition(delta, k, axis=1)[:, k])
    index["width"] = widths
    outside = (delta.astype(np.uint64) >> widths[:, None].astype(np.uint64)) != 0
    counts = outside.sum(axis=1)
    index["exceptions"] = np.cumsum(counts) - counts
    sizes = (widths.astype(np.int64) * block + 7) // 8
    starts = np.cumsum(sizes) - sizes
    index["bits"] = starts
    body = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == w)
        kind, bits = ("<u2", 16) if w <= 16 else ("<u4", 32)
        raw = np.ascontiguousarray(delta[rows]).astype(kind).view(np.uint8)
        plain = np.unpackbits(raw, bitorder="little").reshape(len(rows), block, bits)[:, :, :w]
        packed = np.packbits(plain.reshape(len(rows), -1), axis=1, bitorder="little")
        body[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    at = np.nonzero(outside)
    return b"".join((head, index.tobytes(), body.tobytes(), at[1].astype("<u2").tobytes(), delta[at].astype("<u4").tobytes()))


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first (included) to last (excluded; None: all) of a payload, found by the block index."""
    magic, block, n, blocks = np.frombuffer(payload, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a segment of token blocks")
    last = blocks if last is None else min(last, blocks)
    if not n or first >= last:
        return np.zeros(0, np.uint32)
    index = np.frombuffer(payload, _INDEX, blocks, 16)
    base = 16 + blocks * _INDEX.itemsize
    widths = index["width"].astype(np.int64)
    sizes = (widths * block + 7) // 8
    tail = base + int(index["bits"][-1]) + int(sizes[-1])
    exceptions = (len(payload) - tail) // 6
    positions = np.frombuffer(payload, "<u2", exceptions, tail)
    values = np.frombuffer(payload, "<u4", exceptions, tail + 2 * exceptions)
    body = np.frombuffer(payload, np.uint8, tail - base, base)
    delta = np.zeros((last - first, block), np.uint32)
    for w in np.unique(widths[first:last]):
        if not w:
            continue
        rows = first + np.flatnonzero(widths[first:last] == w)
        size = int(sizes[rows[0]])
        packed = np.zeros((len(rows), size + 5), np.uint8)  # room to read past the last byte
        packed[:, :size] = body[index["bits"][rows].astype(np.int64)[:, None] + np.arange(size)]
        at = np.arange(block) * int(w)
        kind = np.uint32 if w <= 25 else np.uint64
        value = packed[:, at >> 3].astype(kind)
        for k in range(1, (int(w) + 14) // 8):
            value |= packed[:, (at >> 3) + k].astype(kind) << kind(8 * k)
        delta[rows - first] = (value >> (at & 7).astype(kind)) & kind((1 << int(w)) - 1)
    bounds = np.append(index["exceptions"].astype(np.int64), exceptions)
    lo, hi = bounds[first], bounds[last]
    owner = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
    delta[owner, positions[lo:hi]] = values[lo:hi]
    ids = (delta + index["minimum"][first:last][:, None]).ravel()
    return ids[: max(0, min(n, last * block) - first * block)]


_SEGMENTS = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary()),
])
SEGMENT_SCHEMA = "shard int, segment int, first_id bigint, doc_ids array<bigint>, doc_lengths array<bigint>, n_ids bigint, payload binary"


def write_token_blocks(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, order: list[str] | None = None, doc_id: str = "doc_id", text: str = "text",
    block: int = BLOCK, segment_ids: int = SEGMENT_IDS, covered: float = COVERED,
) -> None:
    """Writes the ids of every whole text, each with end_id after it, in ascending order of the ``order`` columns.

    Null text: empty, the end id alone. Null order values come first. Equal order values: by doc_id, then by text, so
    repeated rows each get their ids and identical rows are interchangeable. Empty input: a table without rows. Other
    columns are not read. A document is never split over segments, so a worker holds a segment and a document.
    """
    small_batches(docs.sparkSession, BATCH, "8m")
    keys = [f"__k{i}" for i in range(len(order or [doc_id]))]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(order or [doc_id], keys)))
    by = [*(F.col(k).asc_nulls_first() for k in keys), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        shard, segment, first, ids, names, lengths, size = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(ids), "<u4"), block, covered)
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((shard, segment, first, names, lengths, size, payload), _SEGMENTS)], schema=_SEGMENTS)

        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text"))):
                ids += (raw, end)
                names.append(name)
                lengths.append(len(raw) // 4 + 1)
                size += lengths[-1]
                if size >= segment_ids:
                    yield close()
                    segment, first, ids, names, lengths, size = segment + 1, first + size, [], [], [], 0
        if names:
            yield close()
        enc.rest()

    ordered.mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)


def read_token_blocks(spark, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, one row a document."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one row a shard: as many as the write had tasks, whatever the documents hold
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("__n"))
    before = shards.select("shard", (F.sum("__n").over(Window.orderBy("shard")) - F.col("__n")).alias("__before"))
    out = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, names, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "first_id", "doc_ids", "doc_lengths", "payload"))):
                raw = memoryview(unpack(payload).astype("<u4", copy=False).tobytes())
                n = np.array(lengths, np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), pa.array(names, pa.int64()), pa.array(at + first), pa.array(n), pa.array(crc, pa.int64())], schema=out)

    docs = files.select("shard", "first_id", "doc_ids", "doc_lengths", "payload").mapInArrow(decode, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("at") + F.col("__before")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, order: list[str] | None = None, path: str | None = None, **options) -> DataFrame:
    """Writes the blocks (in the shared folder unless a path is given) and returns what the files say of each document."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-blocks")
    write_token_blocks(docs, path, tokenizer, end_id, order, **options)
    small_batches(spark, 64, "8m")  # a row read back is a whole segment
    return read_token_blocks(spark, path)
