"""Token-id files in patched frame-of-reference blocks.

Ids are cut into blocks of 1,024. A block stores its minimum and, for each id, the difference
to it in ``width`` bits. The width is that of a percentile of the differences (the one, of
``PERCENTILES``, that makes the block shortest); larger differences keep their low bits in
place, and their positions and high bits follow as the exception list. The byte offset of each
block is indexed, so a range of ids is read without decoding what lies before it.

A file is a Parquet folder of rows, a row being a segment of whole documents of about
``SEGMENT`` ids, so Spark's committer makes retried and speculative tasks harmless and any
store that Spark writes to will do. Rows stand in ascending order of doc_id over the
partitions ``part``; ``segment`` counts within one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .pieces import as_ids, pieces

BLOCK, SEGMENT = 1024, 1 << 20
PERCENTILES = (50, 75, 90, 95, 98, 100)
SCHEMA = "part int, segment int, n_ids bigint, doc_id array<bigint>, n_tokens array<bigint>, block_start array<bigint>, block_min binary, width binary, high_bytes binary, n_exceptions binary, payload binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1,024 values below 2**width as rows of 32 * width little-endian words: lane i of every 32 goes to bits [i * width, (i + 1) * width)."""
    lanes = values.astype(np.uint64).reshape(len(values), -1, 32)
    out = np.zeros((*lanes.shape[:2], width + 1), np.uint64)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        moved = lanes[:, :, i] << np.uint64(shift)
        out[:, :, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, :, word + 1] |= moved >> np.uint64(32)
    return out[:, :, :width].astype("<u4").reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    groups = np.zeros((len(words), BLOCK // 32, width + 1), np.uint64)
    groups[:, :, :width] = words.reshape(len(words), -1, width)
    out, mask = np.empty((len(words), BLOCK // 32, 32), np.uint32), np.uint64((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        both = groups[:, :, word] | (groups[:, :, word + 1] << np.uint64(32))
        out[:, :, i] = (both >> np.uint64(shift)) & mask
    return out.reshape(len(words), -1)


def encode_blocks(ids: np.ndarray) -> dict:
    """The block columns of a segment for unsigned 32-bit ids; the last block is filled up with its own last id."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return {"block_start": [0], "block_min": b"", "width": b"", "high_bytes": b"", "n_exceptions": b"", "payload": b""}
    rows = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).reshape(n, BLOCK)
    least = rows.min(axis=1)
    gaps = rows - least[:, None]
    ordered = np.sort(gaps, axis=1)
    top = _bits(ordered[:, -1])
    best, width = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    for p in PERCENTILES:
        at = (BLOCK - 1) * p // 100
        w = _bits(ordered[:, at])
        over = (ordered >= (np.uint64(1) << w.astype(np.uint64))[:, None]).sum(axis=1)
        cost = w * BLOCK // 8 + over * (2 + (top - w + 7) // 8)
        width, best = np.where(cost < best, w, width), np.minimum(best, cost)
    over = gaps >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    counts = over.sum(axis=1)
    high = np.where(counts > 0, (top - width + 7) // 8, 0)
    high[high == 3] = 4
    packed: list[bytes] = [b""] * n
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        words = _pack(gaps[at] & np.uint32((1 << w) - 1), w)
        for i, row in zip(at.tolist(), words):
            packed[i] = row.tobytes()
    where = np.nonzero(over)[1].astype("<u2")
    highs = (gaps.astype(np.uint64) >> width.astype(np.uint64)[:, None])[over]
    ends, out = np.cumsum(counts).tolist(), []
    for i, b in enumerate(ends):
        a = b - int(counts[i])
        out.append(packed[i] + (where[a:b].tobytes() + highs[a:b].astype(f"<u{high[i]}").tobytes() if b > a else b""))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    return {"block_start": starts.tolist(), "block_min": least.astype("<u4").tobytes(), "width": width.astype(np.uint8).tobytes(), "high_bytes": high.astype(np.uint8).tobytes(), "n_exceptions": counts.astype("<u2").tobytes(), "payload": b"".join(out)}


def decode_blocks(row: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` - 1 (all, if not given) of a segment; only their bytes are touched."""
    width, high = np.frombuffer(row["width"], np.uint8), np.frombuffer(row["high_bytes"], np.uint8)
    counts, least = np.frombuffer(row["n_exceptions"], "<u2"), np.frombuffer(row["block_min"], "<u4")
    last = len(width) if last is None else min(last, len(width))
    starts, payload = row["block_start"], memoryview(row["payload"])
    out = np.zeros((max(0, last - first), BLOCK), np.uint32)
    for w in np.unique(width[first:last][width[first:last] > 0]).tolist():
        at = np.flatnonzero(width[first:last] == w)
        out[at] = _unpack(np.stack([np.frombuffer(payload, "<u4", BLOCK // 32 * w, starts[first + i]) for i in at.tolist()]), w)
    for i in np.flatnonzero(counts[first:last]).tolist():
        k, n = first + i, int(counts[first + i])
        at = starts[k] + BLOCK // 8 * int(width[k])
        where = np.frombuffer(payload, "<u2", n, at)
        highs = np.frombuffer(payload, f"<u{high[k]}", n, at + 2 * n).astype(np.uint32)
        out[i, where] |= highs << np.uint32(width[k])
    out += least[first:last, None]
    return out.reshape(-1)[: max(0, row["n_ids"] - first * BLOCK)]


def read_ids(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` - 1 of a segment, through the index of block starts."""
    first = start // BLOCK
    return decode_blocks(row, first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]


def _segments(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment = pieces(path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        docs, sizes, raw, held = [], [], [], 0

        def full() -> pa.RecordBatch:
            ids = as_ids(b"".join(raw))
            row = {"part": part, "segment": segment, "n_ids": len(ids), "doc_id": docs, "n_tokens": sizes, **encode_blocks(ids)}
            return pa.RecordBatch.from_pylist([row], ARROW)

        for batch in batches:
            encoder.trim()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                docs.append(doc)
                sizes.append(len(ids) // 4)
                raw.append(ids)
                held += len(ids) // 4
                if held >= SEGMENT:
                    yield full()
                    segment += 1
                    docs, sizes, raw, held = [], [], [], 0
        if docs:
            yield full()

    return run


_LONGS = pa.list_(pa.int64())
ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_id", _LONGS), ("n_tokens", _LONGS), ("block_start", _LONGS), *((c, pa.binary()) for c in ("block_min", "width", "high_bytes", "n_exceptions", "payload"))])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2) -> None:
    """Encode the whole texts of ``docs`` (doc_id, text) and write the file.

    Null texts count as empty; a null doc_id sorts first; rows of one doc_id are all kept, in
    order of their text. An empty table gives an empty file. Other columns are ignored. The
    range partitioning also takes the text's hash, so many rows of one doc_id can spread.
    """
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ranged.mapInArrow(_segments(tokenizer, end_id), SCHEMA).write.option("compression", "none").parquet(folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            raw, sizes = memoryview(decode_blocks(row).astype("<u4").tobytes()), row["n_tokens"]
            ends = np.cumsum(sizes, dtype=np.int64)
            crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_id"], pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                names=["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the file.

    ``start`` counts the ids of all documents before it. Segment sizes are summed within each
    part (a part's segments only), and the parts' totals, a row each, over the file.
    """
    rows = read_segments(spark, folder)
    sizes = rows.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    offsets = sizes.withColumn("before", before).join(F.broadcast(parts), "part").select("part", "segment", (F.col("before") + F.col("base")).alias("offset"))
    found = rows.mapInArrow(_documents, "part int, segment int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(offsets, ["part", "segment"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
