"""Packing token sequences by multiway Karmarkar-Karp differencing.

A document longer than a window first fills whole windows. The remainders are collected in
groups worth ``windows`` windows, less a few tokens of slack each, and every group is dealt by
the differencing method: each piece is a partition with one loaded window; the two partitions
with the largest spread are merged again and again, the fullest window of one with the
emptiest of the other; the last partition's windows have nearly equal loads. If one exceeds
the capacity, the group is dealt again over one more window.

Cuts are free, so a remainder is halved, and about one in sixteen is cut into pieces of 16
down to 1 tokens: small change with which the last merges level the loads to a token or two.
Groups live within a task, one at a time, so memory is bounded and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .pieces import pieces

SLACK, CHANGE, HALVE_FROM = 3, 16, 64


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """Window (0 to k - 1) of each size, by the largest differencing method over k windows."""
    n = len(sizes)
    loads: dict[int, np.ndarray] = {}
    for i, s in enumerate(sizes):
        loads[i] = np.zeros(k, np.int64)
        loads[i][0] = s
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = loads.pop(a) + loads.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order] - both[order[-1]]
        merges.append((a, b, order))
        loads[n + len(merges) - 1] = both
        heapq.heappush(heap, (-int(both[0]), n + len(merges) - 1))
    windows = {n + len(merges) - 1: np.arange(k)}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        slot = np.empty(k, np.int64)
        slot[order] = windows.pop(n + i)
        windows[a], windows[b] = slot, slot[::-1]
    return np.array([windows[i][0] for i in range(n)], np.int64)


def deal(sizes: list[int], capacity: int, least: int) -> tuple[np.ndarray, int]:
    """Windows of the sizes, none above the capacity, and their number: ``least`` or, where that is exceeded, more."""
    k = least
    while True:
        found = differencing(sizes, k)
        if np.bincount(found, sizes, k).max() <= capacity:
            return found, k
        k += 1


def cut_remainder(length: int, fine: bool) -> list[int]:
    """Lengths into which a remainder is cut: two halves, or small change."""
    if not fine:
        return [length] if length < HALVE_FROM else [length - length // 2, length // 2]
    out, size = [], CHANGE
    while length:
        out.append(min(size, length))
        length -= out[-1]
        size = size - 1 if size > 1 else CHANGE
    return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Packer:
    """Pieces of one task: (doc_id, start, length, crc, doc_tokens, ids), dealt group by group."""

    def __init__(self, part: int, capacity: int, windows: int, keep_ids: bool):
        self.next_id, self.capacity, self.windows, self.keep = part << 40, capacity, windows, keep_ids
        self.goal = windows * (capacity - min(SLACK, capacity - 1))
        self.group, self.total, self.fine, self.out = [], 0, 0, []

    def piece(self, doc, start: int, length: int, ids: bytes, n: int) -> tuple:
        raw = ids[4 * start : 4 * (start + length)]
        return doc, start, length, zlib.crc32(raw), n, raw if self.keep else None

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        rest = n % self.capacity
        for start in range(0, n - rest, self.capacity):
            self.out.append((*self.piece(doc, start, self.capacity, ids, n), self.next_id, 0))
            self.next_id += 1
        fine = bool(rest) and self.fine * CHANGE <= self.total
        self.fine += rest * fine
        start = n - rest
        for length in cut_remainder(rest, fine):
            while length:
                part = min(length, self.goal - self.total)
                self.group.append(self.piece(doc, start, part, ids, n))
                self.total, start, length = self.total + part, start + part, length - part
                if self.total == self.goal:
                    self.close(self.windows)

    def close(self, least: int | None = None) -> None:
        if not self.group:
            return
        least = least or -(-self.total // self.capacity)
        found, k = deal([p[2] for p in self.group], self.capacity, least)
        filled = [0] * k
        for piece, w in zip(self.group, found.tolist()):
            self.out.append((*piece, self.next_id + w, filled[w]))
            filled[w] += piece[2]
        self.next_id += k
        self.group, self.total, self.fine = [], 0, 0

    def batch(self) -> pa.RecordBatch:
        doc, start, length, crc, n, raw, sequence, offset = zip(*self.out) if self.out else [()] * 8
        self.out = []
        columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, n, sequence, offset)]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if self.keep else []), names=COLUMNS + (["ids"] if self.keep else []))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 0, windows: int = 32, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents (doc_id, text), each in a sequence of at most ``capacity`` ids.

    Columns as in ``COLUMNS``; with ``keep_ids`` also ``ids``, the piece's little-endian
    unsigned 32-bit ids. ``offset`` is gapless from 0 in a sequence, ``sequence_id`` holds the
    task in its upper bits. Null text: empty, so only ``end_id`` remains (without one, no
    row). Rows with a null or repeated doc_id are packed like any other; an empty table gives
    no row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = pieces(tokenizer), _Packer(TaskContext.get().partitionId(), capacity, windows, keep_ids)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if i % 500 == 0:
                    encoder.trim()
                packer.add(doc, encoder.encode(text) + end)
                if len(packer.out) > (2_000 if keep_ids else 20_000):
                    yield packer.batch()
        packer.close()
        yield packer.batch()

    schema = ", ".join(f"{c} bigint" for c in COLUMNS) + (", ids binary" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
